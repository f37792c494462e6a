"""Where intermediate tables go."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs
from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster, or the session's own ``setCheckpointDir``, names; never a guess."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, with the file system that Spark takes it for, so that tasks open the same one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/(?!/)", "file:///", whole)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`scratch_path` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_table(spark: SparkSession, label: str) -> Iterator[str]:
    """A path for a table that is read within the block only."""
    path = scratch_path(spark, label)
    try:
        yield path
    finally:
        remove(spark, path)


def open_files(folder: str, recursive: bool = False) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    """The file system of a shared table's folder and its Parquet files in order, for a task that reads them."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    return fs, sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=recursive)) if f.path.endswith(".parquet"))
