"""Operator 10: exact top-k by inner product as a Voronoi join.

Pivots split the space into cells. Of every cell a summary is kept: the members with the highest
product with the pivot. They give every query a lower bound for its k-th best score, and every cell
of queries the least of these bounds and the largest distance s of a query from the pivot p. A row x
can matter to a query of the cell only if p·x + s|x| reaches that bound, as no query of the cell
has a larger product with x. Cells are put together to groups of bounded size (larger ones are split),
each row is sent only to the groups it can matter to, in chunks of bounded size, and each chunk is
solved with the group's queries, which are written once and read by the chunk's task. How much is left out depends on the data: the bounds are exact, and
where they do not part the data, rows go to all groups.

Components are floor(1024 x), held as doubles, in which products below 2^53 are exact; larger ones
are computed with whole numbers of any length and kept within the range of a long.

Cases: see :func:`costdocs.llm.vectors.usable`. Of equal scores the smaller id comes first. Rows
that share an id are candidates, and queries, of their own; a query leaves out its own row only. Zero
vectors score zero. With fewer than k other rows all are returned. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costdocs.llm.common import open_store, staged
from costdocs.llm.vectors import best_of, lists, matrix, ranked, usable, width
from costdocs.sources.scratch import scratch_path

PIVOTS = 1024  # at most; below, the square root of the number of rows
GROUP_QUERIES = 16_384
CHUNK_ROWS = 8_192
TILE = 1 << 22  # scores held at a time
SCALE = 1024.0
EXACT = float(1 << 53)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v) with floor(1024 x) for every component x."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            with np.errstate(over="ignore"):
                scaled = np.floor(np.clip(SCALE * v.flatten().to_numpy(zero_copy_only=False), -1.7e308, 1.7e308))
            offsets = pa.array(np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32))
            columns = [batch.column("row"), batch.column("vec_id"), pa.ListArray.from_arrays(offsets, pa.array(scaled))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "v"])

    return vectors.mapInArrow(scale, "row long, vec_id long, v array<double>")


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, as doubles that hold whole numbers or, beyond 2^53, as Python integers."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows)))
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1]) < EXACT:
        return queries @ rows.T
    big = np.vectorize(int, otypes=[object])
    return np.clip(big(queries) @ big(rows).T, -(1 << 63), (1 << 63) - 1)


def _cells(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every row, and the distance from it."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = np.nan_to_num((pivots**2).sum(1)[None, :] - 2 * rows @ pivots.T, nan=np.inf)
        cell = square.argmin(1)
        return cell, np.linalg.norm(rows - pivots[cell], axis=1)


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-scores.astype(np.float64), kind="stable")[:k]


def summaries(rows: DataFrame, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors) of the k + 1 members of each cell with the highest product with its pivot."""
    size = pivots.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("row").to_numpy(), matrix(batch.column("v"), size)
            cell, _ = _cells(v, pivots)
            with np.errstate(over="ignore", invalid="ignore"):
                near = np.nan_to_num(np.einsum("ij,ij->i", v, pivots[cell]))
            order = np.lexsort((ids, -near, cell))
            order = order[np.arange(len(order)) - np.searchsorted(cell[order], cell[order]) <= k]
            columns = [pa.array(cell[order].astype(np.int32)), pa.array(near[order]), pa.array(ids[order]), lists(v[order])]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "near", "row", "v"])

    found = rows.mapInArrow(best, "cell int, near double, row long, v array<double>")
    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("near"), "row"))
    kept = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("row", "v").orderBy("row").toArrow()
    return kept["row"].to_numpy(), matrix(kept["v"], size)


def bounded_queries(queries: DataFrame, pivots: np.ndarray, known: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(query_row, query_id, q, cell, away, least): cell, distance from its pivot, and a bound for the k-th best score."""
    size, (ids, members) = pivots.shape[1], known

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                query_rows, q = part.column("row").to_numpy(), matrix(part.column("v"), size)
                cell, away = _cells(q, pivots)
                scores = products(q, members).astype(np.float64)
                scores[query_rows[:, None] == ids[None, :]] = -np.inf
                least = -np.sort(-scores, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(q), -np.inf)
                columns = [part.column("row"), part.column("vec_id"), lists(q), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(least)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "q", "cell", "away", "least"])

    return queries.mapInArrow(bound, "query_row long, query_id long, q array<double>, cell int, away double, least double")


def plan_groups(cells: list[tuple[int, int]], pivots: np.ndarray, group_queries: int) -> dict[int, tuple[int, int]]:
    """(first group, number of groups) of each cell (number, queries): near cells share groups."""
    left, order = dict(cells), []
    at = min(left, default=None)
    while left:
        order.append((at, left.pop(at)))
        if left:
            others = list(left)
            at = others[int(_first(-np.linalg.norm(pivots[others] - pivots[at], axis=1), 1)[0])]
    groups, group, filled = {}, 0, 0
    for cell, count in order:
        if filled and filled + count > group_queries:
            group, filled = group + 1, 0
        many = -(-count // group_queries)
        groups[cell] = (group, many)
        group, filled = (group + many, 0) if many > 1 else (group, filled + count)
    return groups


def voronoi_top_k(
    vectors: DataFrame, every: int = 100, k: int = 10, pivot_count: int | None = None, group_queries: int = GROUP_QUERIES, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest products for each ``every``-th id."""
    spark = vectors.sparkSession
    hits_schema = "query_row long, query_id long, vec_id long, score long"
    rows = staged(whole_numbers(usable(vectors, nonzero=False)), "whole-vectors")
    size = width(rows)
    count = rows.count()
    pivot_count = pivot_count or min(PIVOTS, max(16, math.isqrt(count)))
    pivots = matrix(rows.orderBy(F.xxhash64("row"), "row").limit(pivot_count).select("v").toArrow()["v"], size)
    if not len(pivots):
        return ranked(spark.createDataFrame([], hits_schema), k, [F.desc("score"), F.col("vec_id")])
    known = summaries(rows, pivots, k)
    queries = staged(bounded_queries(rows.where(F.col("vec_id") % every == 0), pivots, known, k), "bounded-queries")
    cells = queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.min("least").alias("least")).orderBy("cell").collect()
    groups = plan_groups([(r["cell"], r["n"]) for r in cells], pivots, group_queries)
    of_cell = np.array([r["cell"] for r in cells], np.int64)
    away, least = np.array([r["away"] for r in cells]), np.array([r["least"] for r in cells])
    group_count = max((first + many for first, many in groups.values()), default=0)
    chunks = max(1, -(-count // chunk_rows))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to the groups with a cell that it can matter to."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = matrix(part.column("v"), size)
                with np.errstate(over="ignore", invalid="ignore"):
                    most = v @ pivots[of_cell].T + np.linalg.norm(v, axis=1)[:, None] * away[None, :]
                    # Rounding must not drop a row: the bound is widened far beyond its error.
                    most = most + 1e-9 * (np.abs(most) + np.abs(v) @ np.abs(pivots[of_cell]).T) + 1
                    reaches = ~(most < least[None, :])
                to = np.zeros((group_count, len(v)), bool)
                for c, cell in enumerate(of_cell.tolist()):
                    first, many = groups[cell]
                    to[first : first + many] |= reaches[:, c]
                group, row = np.nonzero(to)
                columns = [pa.array(group.astype(np.int32)), *(part.column(c).take(pa.array(row)) for c in ("row", "vec_id", "v"))]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "row", "vec_id", "v"])

    def solve(data: pa.Table) -> pa.Table:
        """A chunk of a group's rows with the group's queries, which are read block by block."""
        found = [[], [], [], []]
        ids, numbers, x = data["vec_id"].to_numpy(), data["row"].to_numpy(), matrix(data["v"], size)
        fs, folder = open_store(f"{asked_path}/group={data['group'][0].as_py()}")
        found_files = fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))  # a part of a large cell may have no query
        for name in sorted(f.path for f in found_files if f.path.endswith(".parquet")):
            asked = pq.read_table(name, filesystem=fs, partitioning=None)
            query_rows, query_ids, q = asked["query_row"].to_numpy(), asked["query_id"].to_numpy(), matrix(asked["q"], size)
            step = max(1, TILE // len(ids))
            for at in range(0, len(q), step):
                scores = products(q[at : at + step], x)
                big = scores.dtype == object
                order = scores.astype(np.float64)
                order[query_rows[at : at + step, None] == numbers[None, :]] = -np.inf
                row, place = _exact_best(scores, order, ids, k) if big else best_of(order, ids[None, :], k)
                for values, new in zip(found, (query_rows[at + row], query_ids[at + row], ids[place], scores[row, place].astype(np.int64))):
                    values.append(new)
        columns = [pa.array(np.concatenate(f) if f else [], pa.int64()) for f in found]
        return pa.table(columns, names=["query_row", "query_id", "vec_id", "score"])

    group_of = F.create_map(*[F.lit(x) for cell, (first, many) in groups.items() for x in (cell, first)]) if groups else None
    many_of = F.create_map(*[F.lit(x) for cell, (first, many) in groups.items() for x in (cell, many)]) if groups else None
    if group_of is None:
        return ranked(spark.createDataFrame([], hits_schema), k, [F.desc("score"), F.col("vec_id")])
    block = F.pmod(F.xxhash64("query_row"), F.element_at(many_of, F.col("cell"))).cast("int")
    asked = queries.select((F.element_at(group_of, F.col("cell")) + block).cast("int").alias("group"), "query_row", "query_id", "q")
    asked_path = scratch_path(spark, "group-queries")
    asked.repartition("group").write.partitionBy("group").parquet(asked_path)
    sent = rows.mapInArrow(send, "group int, row long, vec_id long, v array<double>").withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    hits = sent.groupBy("group", "chunk").applyInArrow(solve, hits_schema)
    return ranked(hits, k, [F.desc("score"), F.col("vec_id")])


def _exact_best(scores: np.ndarray, order: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`best_of` where doubles cannot tell all scores apart."""
    rows, places = [], []
    for r in range(len(scores)):
        allowed = np.flatnonzero(np.isfinite(order[r])).tolist()
        best = sorted(allowed, key=lambda c: (-scores[r, c], ids[c]))[:k]
        rows += [r] * len(best)
        places += best
    return np.array(rows, np.int64), np.array(places, np.int64)
