"""Reading Parquet tables with enough tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A Parquet table; a small one is spread over all cores by a column with many values.

    A file with a single row group is read by one task, whatever work follows. A scan that has
    at least as many splits as there are cores, as any large table has, is left as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_by is None or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, spread_by)
