"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as stored; column pruning and filters reach the scan.  Timestamps without a zone are read as UTC ones."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoned = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in zoned}) if zoned else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the scan has fewer parts than there are cores, as one small file has.

    A table of many splits is left as it is, so at scale this adds no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
