"""Snapshots of a stored table set: readers open what the newest record names, and nothing else.

Data files go to a folder of their own per write (``data/version=…``), which no reader looks into
before a record names it. A record is a folder of JSON rows, one per month, which is written under a
hidden name and appears by one rename that fails when its number is taken. A writer that loses reads
the newer record and tries again; so two months can be written at once. A write that fails, wherever
it stops, leaves what readers see as it was. The record before the newest one and its files stay, for
readers that are under way; older ones are removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from costdocs.sources.scratch import remove

RECORDS = "manifest"
KEPT = 2  # records, and the versions that they name
TRIES = 20
_RECORD = re.compile(r"snapshot-(\d{8})")


def new_version() -> str:
    return f"v{uuid.uuid4().hex}"  # never a number


def version_folder(base: str, version: str) -> str:
    return f"{base}/data/version={version}"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def records(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """(number, folder) of the published records, oldest first."""
    where = _path(spark, f"{base}/{RECORDS}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(where)]
    return sorted((int(m[1]), f"{base}/{RECORDS}/{m[0]}") for m in map(_RECORD.fullmatch, names) if m)


def rows_of(spark: SparkSession, folder: str | None, schema: T.StructType) -> DataFrame:
    """A record's rows; none without a record."""
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).json(folder)


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Whether the folder has got its name; False when another writer has it."""
    jvm = spark._jvm
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    where = _path(spark, source)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration())
    try:
        files.rename(where, _path(spark, target), options)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def publish(
    spark: SparkSession, base: str, schema: T.StructType, version: str, made: Callable[[DataFrame], DataFrame], expected: int | None = None
) -> bool:
    """Make the next record from the rows of the newest one; what it names is what readers see from then on.

    With ``expected``, the number of the newest record, nothing is published once there is a newer one.
    """
    for _ in range(TRIES):
        known = records(spark, base)
        number = known[-1][0] + 1 if known else 1
        if expected is not None and number != expected + 1:
            return False
        hidden = f"{base}/{RECORDS}/_{version}-{number}"
        made(rows_of(spark, known[-1][1] if known else None, schema)).coalesce(1).write.mode("overwrite").json(hidden)
        if _renamed(spark, hidden, f"{base}/{RECORDS}/snapshot-{number:08d}"):
            _expire(spark, base, schema)
            return True
        remove(spark, hidden)
    raise RuntimeError(f"{base} is written by too many at once")


def _expire(spark: SparkSession, base: str, schema: T.StructType) -> None:
    """Remove records before the last two, and versions that only they name."""
    known = records(spark, base)
    old, kept = known[:-KEPT], known[-KEPT:]
    if not old:
        return

    def versions(folders: list[tuple[int, str]]) -> set[str]:
        rows = spark.read.schema(schema).json([folder for _, folder in folders])
        return {r["version"] for r in rows.select("version").distinct().collect()}

    for version in versions(old) - versions(kept):
        remove(spark, version_folder(base, version))
        remove(spark, f"{base}/manifest_files/version={version}")
    for _, folder in old:
        remove(spark, folder)
