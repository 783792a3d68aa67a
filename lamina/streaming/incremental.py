"""Incremental index: new chunk files are embedded and appended, ids already stored are left alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def index_stream(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], key: str = "chunk_id") -> StreamingQuery:
    """Reads Parquet chunk files as they arrive; each micro-batch is anti-joined with the index and appended.

    A batch that is run again after a failure finds its rows stored and adds none."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        try:
            stored = spark.read.parquet(target).select(key)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = None
        fresh = new.join(stored, key, "left_anti") if stored is not None else new
        embed(fresh).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
