"""The chunk store: folders by the first digits of the text hash, appended and compacted by snapshots.

A batch looks for known hashes in the folders of its own prefixes only, and of these reads one column.
Every append is a version of its own, which the newest record names per prefix with its number of
files; when a prefix has too many, its files are written anew as one version and the record is
replaced. Readers never see half an append, nor a row twice while files are put together.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.plans import snapshots
from costdocs.sources.scratch import remove

PREFIX = "hash_prefix"
DIGITS = 2  # of the hash, in a new store
MAX_FILES = 8  # per prefix, before they are put together
RECORD = T.StructType(
    [T.StructField(n, t) for n, t in ((PREFIX, T.StringType()), ("version", T.StringType()), ("files", T.LongType()), ("rows", T.LongType()), ("columns", T.StringType()))]
)


def prefix_of(text_hash: Column, digits: int) -> Column:
    """The folder of a hash; the letter keeps it from being read as a number."""
    return F.concat(F.lit("h"), F.left(text_hash, F.lit(digits)))


def _record(spark: SparkSession, path: str) -> tuple[int, list]:
    """(number, rows) of the newest record: one row per prefix and version in use, a few thousand at most."""
    known = snapshots.records(spark, path)
    if not known:
        return 0, []
    return known[-1][0], snapshots.rows_of(spark, known[-1][1], RECORD).collect()


def digits_of(spark: SparkSession, path: str) -> int:
    _, rows = _record(spark, path)
    return len(rows[0][PREFIX]) - 1 if rows else DIGITS


def read(spark: SparkSession, path: str, prefixes: Iterable[str] | None = None) -> DataFrame | None:
    """The stored chunks, or those of some prefixes: only their folders are looked into. None without a store."""
    _, rows = _record(spark, path)
    return _read(spark, path, rows, prefixes) if rows else None


def _read(spark: SparkSession, path: str, rows: list, prefixes: Iterable[str] | None = None) -> DataFrame:
    wanted = None if prefixes is None else set(prefixes)
    in_use: dict[str, list[str]] = {}
    for r in rows:
        in_use.setdefault(r["version"], [])
        if wanted is None or r[PREFIX] in wanted:
            in_use[r["version"]].append(r[PREFIX])
    # An append that brought new columns is the last to be looked at; older files have nulls in them.
    fields = {f.name: f for r in rows if r["columns"] for f in T.StructType.fromJson(json.loads(r["columns"])).fields}
    schema = T.StructType([*fields.values(), T.StructField("version", T.StringType()), T.StructField(PREFIX, T.StringType())])
    folders = [snapshots.version_folder(path, v) for v, some in in_use.items() if some]
    if not folders:
        return spark.createDataFrame([], T.StructType(list(fields.values())))
    current = F.lit(False)
    for version, some in in_use.items():
        if some:
            current = current | ((F.col("version") == version) & F.col(PREFIX).isin(sorted(some)))
    df = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders)
    return df.where(current).select(*fields)


def _write(spark: SparkSession, path: str, version: str, rows: DataFrame, digits: int) -> DataFrame:
    """Write a version; its record rows, from a look at its files that reads no column."""
    folder = snapshots.version_folder(path, version)
    placed = rows.withColumn(PREFIX, prefix_of(F.col("text_hash"), digits))
    placed.hint("rebalance", PREFIX).sortWithinPartitions(PREFIX, "text_hash").write.partitionBy(PREFIX).parquet(folder)
    seen = spark.read.schema(T.StructType([T.StructField(PREFIX, T.StringType())])).parquet(folder)
    found = seen.groupBy(PREFIX).agg(F.countDistinct("_metadata.file_path").alias("files"), F.count("*").alias("rows"))
    return found.select(PREFIX, F.lit(version).alias("version"), "files", "rows", F.lit(rows.schema.json()).alias("columns"))


def append(spark: SparkSession, path: str, fresh: Callable[[Callable[[DataFrame], DataFrame | None]], DataFrame]) -> None:
    """Add the rows that ``fresh`` makes; it is given a function from hashed rows to the stored rows of their prefixes.

    When another writer is first, ``fresh`` is asked again, so that nothing is stored twice.
    """
    for _ in range(snapshots.TRIES):
        number, rows = _record(spark, path)
        digits = len(rows[0][PREFIX]) - 1 if rows else DIGITS

        def near(batch: DataFrame) -> DataFrame | None:
            if not rows:
                return None
            prefixes = [r[0] for r in batch.select(prefix_of(F.col("text_hash"), digits)).distinct().collect()]  # at most 16 ** digits
            return _read(spark, path, rows, prefixes)

        version = snapshots.new_version()
        try:
            made = _write(spark, path, version, fresh(near), digits)
            done = snapshots.publish(spark, path, RECORD, version, lambda old: old.unionByName(made), expected=number)
        except Exception:
            remove(spark, snapshots.version_folder(path, version))
            raise
        if done:
            compact(spark, path)
            return
        remove(spark, snapshots.version_folder(path, version))
    raise RuntimeError(f"{path} is written by too many at once")


def compact(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> bool:
    """Put the files of prefixes that have more than ``max_files`` together; whether there were any."""
    number, rows = _record(spark, path)
    files: dict[str, int] = {}
    for r in rows:
        files[r[PREFIX]] = files.get(r[PREFIX], 0) + r["files"]
    many = sorted(p for p, n in files.items() if n > max_files)
    if not many:
        return False
    version = snapshots.new_version()
    made = _write(spark, path, version, _read(spark, path, rows, many), len(rows[0][PREFIX]) - 1)
    # Whoever appends meanwhile wins: the next append finds the prefixes again.
    if not snapshots.publish(spark, path, RECORD, version, lambda old: old.where(~F.col(PREFIX).isin(many)).unionByName(made), expected=number):
        remove(spark, snapshots.version_folder(path, version))
        return False
    return True
