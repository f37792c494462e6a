"""Keeping the first of equal rows, and leaving out what is already stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costdocs.functions.text import strip_space
from costdocs.operators.joins import bounded_copy


def keep_first(df: DataFrame, key: Column, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The first row, by ``order``, of every ``key``, within each of ``keys``; rows that tie are told apart by the other columns.

    A group may hold a large part of all rows (boilerplate, copies), so no window sorts it
    in one task: the minimum is taken inside each map task and merged after the shuffle.
    """
    rest = [c for c in df.columns if c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], key.alias("_key")).agg(row).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def prefix_key(text: Column, length: int = 100) -> Column:
    return strip_space(F.left(text, F.lit(length)))


def dedup_by_prefix(
    df: DataFrame, text: str, order: Sequence[str], length: int = 100, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows whose texts start alike count as one: per query, for contexts, with its key and the rank as order."""
    return keep_first(df, prefix_key(F.col(text), length), order, keys)


def with_text_hash(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("text_hash", F.md5(F.col(text)))


def dedup_by_hash(df: DataFrame, order: Sequence[str], hash_column: str = "text_hash") -> DataFrame:
    return keep_first(df, F.col(hash_column), order)


def _stored_hashes(df: DataFrame, store: DataFrame, hash_column: str) -> DataFrame:
    """The store's hashes that rows of the batch can have, in one column.

    The batch's hashes go to the store as long as they are small, so that a small batch does not
    move a large store. Larger ones leave all of the store's; they are merged in the map tasks, not salted.
    """
    hashes, small = store.select(hash_column), bounded_copy(df.select(hash_column).distinct())
    return hashes if small is None else hashes.join(F.broadcast(small), hash_column, "left_semi")


def dedup_unknown(df: DataFrame, store: DataFrame, order: Sequence[str], hash_column: str = "text_hash") -> DataFrame:
    """:func:`dedup_by_hash` and :func:`drop_known` with one shuffle of the rows.

    The store's hashes meet the rows as marks without values, in the same merging by hash. Rows
    without a hash are a group like any other, and never known.
    """
    rest = [c for c in df.columns if c not in order]
    rows = df.select(F.col(hash_column).alias("_key"), F.struct(*order, *rest).alias("_row"), F.lit(False).alias("_known"))
    hashes = _stored_hashes(df, store, hash_column).where(F.col(hash_column).isNotNull())
    marks = hashes.select(F.col(hash_column).alias("_key"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_known"))
    first = rows.unionByName(marks).groupBy("_key").agg(F.min("_row").alias("_row"), F.max("_known").alias("_known"))
    return first.where(~F.col("_known")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def drop_known(df: DataFrame, store: DataFrame, hash_column: str = "text_hash") -> DataFrame:
    """Rows whose hash is not in the store. Run it after :func:`dedup_by_hash`: then no hash is hot."""
    return df.join(_stored_hashes(df, store, hash_column).distinct(), hash_column, "left_anti").select(*df.columns)
