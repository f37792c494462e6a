"""The first rows of a table or of each key, in an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK_GROUPS = 256


def first_rows(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The ``n`` first rows by ``order``, of every key or of all, with their rank.

    Every task drops all but its own first rows, groups of tasks keep theirs, and only what
    the groups keep is ranked per key. So however many tasks there are, and however many rows
    one key has, the last step sees at most ``n`` rows per key and group.
    """
    grouped = df.withColumn("_group", F.spark_partition_id() % TASK_GROUPS)
    by_group = Window.partitionBy(*keys, "_group").orderBy(*order)
    kept = grouped.withColumn(rank, F.row_number().over(by_group)).where(F.col(rank) <= n).drop("_group", rank)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
