"""Joining a large table with a lookup table whose size is not known beforehand."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.sources.scratch import scratch_table

MAX_LOOKUP_ROWS = 100_000
MAX_LOOKUP_BYTES = 64 << 20
SALTS = 32


def observed(seen: Observation) -> dict[str, int]:
    """What a write has counted; nothing where Spark found the rows to be none and ran no counting plan."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def _weight(df: DataFrame) -> Column:
    """Bytes of a table: 8 for a fixed value, the length of a text or list."""
    sizes = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif kind == "array" and not isinstance(field.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            sizes.append(8 * F.greatest(F.size(column), F.lit(0)))
        elif kind in ("array", "map", "struct", "variant"):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)))
    return F.coalesce(F.sum(sum((s.cast("long") for s in sizes), F.lit(8 * len(df.columns)).cast("long"))), F.lit(0))


def weigh(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a table, counted by its tasks."""
    return tuple(df.agg(F.count("*"), _weight(df)).first())


def bounded_copy(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS, max_bytes: int = MAX_LOOKUP_BYTES) -> DataFrame | None:
    """The rows as local data when there are at most ``max_rows`` of at most ``max_bytes``, else None.

    The table is written once, and its rows and bytes are counted by the tasks that write it; it is
    read back only where it is known to be small. No more rows than the bound and one are written.
    """
    spark, seen = df.sparkSession, Observation()
    with scratch_table(spark, "lookup") as path:
        df.limit(max_rows + 1).observe(seen, F.count("*").alias("rows"), _weight(df).alias("bytes")).write.parquet(path)
        found = observed(seen)
        if found.get("rows", 0) > max_rows or found.get("bytes", 0) > max_bytes:
            return None
        return spark.createDataFrame(spark.read.schema(df.schema).parquet(path).toArrow(), df.schema)


def lookup_join(
    big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str, max_rows: int = MAX_LOOKUP_ROWS
) -> DataFrame:
    """Join on equal keys, ``left`` or ``left_semi``; ``lookup`` has each key once.

    A lookup with a counted small size is sent to the tasks, so that ``big`` is not moved. A
    larger one is repeated per salt, and the rows of ``big`` are spread over the salts by the
    task they come from, so that a key with a third of all rows is handled by many tasks.
    """
    small = bounded_copy(lookup, max_rows)
    if small is not None:
        return big.join(F.broadcast(small), list(keys), how)
    salted = big.withColumn("_salt", F.spark_partition_id() % SALTS)
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
