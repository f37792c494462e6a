"""What both vector searches do with the table of vectors and with hits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(row, vec_id, v) with finite components as doubles; rows that share an id are rows of their own.

    Null ids and null vectors, and those that hold null or non-finite components, take no part. The
    row numbers hold once the result is written.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    limit = float(np.finfo(np.float64).max)
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > limit)))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def width(vectors: DataFrame) -> int:
    """The length of the longest vector; shorter ones count as padded with zeros."""
    return vectors.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A column of lists as rows of one matrix, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), size))
    if len(column):
        offsets = column.offsets.to_numpy().astype(np.int64)
        lengths = np.diff(offsets)
        row = np.repeat(np.arange(len(column)), lengths)
        place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)
        out[row, place] = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    flat = pa.array(np.ascontiguousarray(rows, np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k highest finite scores of each row of a matrix; equal ones by smaller id.

    ``ids`` has a row of ids or one for each row of scores.
    """
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > k:
        border = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, place = np.nonzero((scores >= border[:, None]) & np.isfinite(scores))
    else:
        row, place = np.nonzero(np.isfinite(scores))
    order = np.lexsort((ids[row, place], -scores[row, place], row))
    row, place = row[order], place[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], place[nth < k]


def ranked(hits: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The k best hits of every query row; two queries of one id have ranks of their own."""
    from costdocs.operators.ranking import first_rows

    return first_rows(hits, k, order, ["query_row"]).select("query_id", "rank", "vec_id", "score")
