"""Helpers that the operators share: tables, staged results, files in the shared folder."""

from __future__ import annotations

import posixpath
import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.sources.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: a lost executor recomputes nothing before it."""
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df, label))


def staged_path(df: DataFrame, label: str) -> str:
    """The folder in the shared folder to which the rows were written, for tasks that read it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Within the block, what a query has shuffled leaves the disks when the query ends; else it stays until the driver collects garbage."""
    before = spark.conf.get(LET_GO, "false")
    spark.conf.set(LET_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(LET_GO, before)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = 2 << 20) -> Iterator[None]:
    """Queries run within the block hand their rows to Python about ``size`` bytes at a time, however long the texts are."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder or file; a path without a scheme is a local one."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_then_rename(fs: pa.fs.FileSystem, path: str):
    """A context that gives a file which appears under its name only when it is complete."""

    class _Whole:
        def __enter__(self):
            fs.create_dir(posixpath.dirname(path), recursive=True)
            self.out = fs.open_output_stream(path + ".open", compression=None)
            return self.out

        def __exit__(self, kind, *_):
            self.out.close()
            if kind is None:
                fs.move(path + ".open", path)
            else:
                fs.delete_file(path + ".open")

    return _Whole()


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, which serves several tasks in turn."""
    name = "_costdocs_worker"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    return module.__dict__.setdefault("cache", {})


def ranges(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] … starts[i] + lengths[i] - 1`` of every i, one after the other."""
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(lengths.sum())


def text_batches(batch: pa.RecordBatch, column: str, chars: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """Runs of a batch's texts of about ``chars`` characters: (index of the first, texts)."""
    texts, first, size, run = batch.column(column), 0, 0, []
    for i, value in enumerate(texts):
        value = value.as_py()
        run.append(value)
        size += len(value) if value else 0
        if size >= chars:
            yield first, run
            first, size, run = i + 1, 0, []
    if run:
        yield first, run


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Equality of key pairs in which null equals null."""
    condition = F.lit(True)
    for a, b in keys.items():
        condition = condition & left[a].eqNullSafe(right[b])
    return condition
