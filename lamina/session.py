"""Session defaults and the folder in which lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}
#: Keys that go to every executor at once.
KEYS = 100_000


def local_session(cores: int | str = 8, app: str = "lamina", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster the caller's session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only where none is set and the master is local, as in tests, a folder of our
    own that is removed when the process ends."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN.append(tempfile.TemporaryDirectory(prefix="lamina-checkpoint-", ignore_cleanup_errors=True))
        shared = _OWN[-1].name
    context.setCheckpointDir(shared)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def among(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose key `wanted` has, found where they lie, so that the others are not shuffled by the join to come.

    More than KEYS keys are left to that join.  `wanted` is read twice."""
    keys = wanted.select(key).distinct()
    return df.join(F.broadcast(keys), key, "left_semi") if keys.limit(KEYS + 1).count() <= KEYS else df
