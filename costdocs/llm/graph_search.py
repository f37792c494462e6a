"""Operator 4: approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Rows are dealt to shards by a hash of their number. A shard's graph starts as a random one. In each
round a beam search from the shard's entries proposes neighbours for every node; they are pruned
with a relaxed distance, so that a neighbour is dropped if a kept one is nearer to it by a factor
``relax`` (one in the first round) than the node is, and edges are then added in the other direction
and pruned again. Equal vectors share a node, which lists all their rows. Every query is searched in
every shard by a wider beam, all that the beam holds is scored exactly on the original vectors, and
the best hits of all shards are ranked.

Clusters do not part a graph: its entries are the middle node and nodes far from each other, every
node keeps some random edges, and nodes that no entry reaches are linked to the nearest one reached.

The index is a table with a row per shard; queries are read from a written table block by block, so
neither is held whole by a task or the driver.

Cases: see :func:`costdocs.llm.vectors.usable`; zero vectors take no part either. Of equal scores the
smaller id comes first. Rows that share an id are candidates, and queries, of their own; a query leaves
out its own row only. Queries whose vector takes no part have no rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costdocs.llm.common import open_store, ranges, staged
from costdocs.llm.vectors import matrix, ranked, usable, width
from costdocs.sources.scratch import scratch_path


@dataclass(frozen=True)
class Graphs:
    shard_rows: int = 4096
    degree: int = 32
    beam: int = 64  # while building
    wide_beam: int = 192  # while searching
    relax: float = 1.2
    rounds: int = 2
    seed: int = 4
    entries: int = 48  # where a search starts
    random: int = 4  # edges of a node that are never pruned, besides the degree


def beam_search(units: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) in the beam of every query, nearest first; -1 where the beam is not full."""
    count, every = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((count, len(units) + 1), bool)
    wide = max(beam, len(entries))
    nodes = np.full((count, wide), -1)
    far = np.full((count, wide), np.inf, np.float32)
    open_ = np.zeros((count, wide), bool)
    first = slice(0, len(entries))
    nodes[:, first], far[:, first], open_[:, first] = entries, 1 - queries @ units[entries].T, True
    order = np.argsort(far, axis=1, kind="stable")[:, :beam]
    nodes, far, open_ = nodes[every, order], far[every, order], open_[every, order]
    seen[:, entries] = seen[:, -1] = True
    while open_.any():
        # The nearest nodes that have not been expanded, a few per query at a time.
        at = np.argsort(~open_, axis=1, kind="stable")[:, :step]
        chosen = np.where(open_[every, at], nodes[every, at], -1)
        open_[every, at] = False
        near = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(count, -1)
        near[seen[every, near]] = -1
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[every, near] = True
        distance = 1 - np.matmul(units[near], queries[:, :, None])[:, :, 0]
        distance[near < 0] = np.inf
        all_far, all_nodes = np.concatenate([far, distance], 1), np.concatenate([nodes, near], 1)
        all_open = np.concatenate([open_, near >= 0], 1)
        kept = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far, nodes, open_ = all_far[every, kept], all_nodes[every, kept], all_open[every, kept]
    return nodes, far


def robust_prune(units: np.ndarray, of: np.ndarray, nodes: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of every node ``of`` among its candidates (-1: none).

    Taken nearest first; a candidate goes once a kept one is nearer to it, by the factor, than the node is.
    """
    every = np.arange(len(of))
    nodes = np.sort(np.where(nodes == of[:, None], -1, nodes), axis=1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    points = units[nodes]
    far = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(points, units[of][:, :, None])[:, :, 0]))
    far[nodes < 0] = np.inf
    between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(points, points.transpose(0, 2, 1))))
    left, kept = far.copy(), np.full((len(of), degree), -1)
    for slot in range(degree):
        best = left.argmin(1)
        some = np.isfinite(left[every, best])
        if not some.any():
            break
        kept[some, slot] = nodes[every, best][some]
        left[relax * between[every, best] <= far] = np.inf
        left[every, best] = np.inf
    return kept


def _with_reverse(units: np.ndarray, edges: np.ndarray, degree: int, relax: float, block: int) -> np.ndarray:
    """Edges in both directions, pruned to the degree; of very many the nearest are looked at."""
    source, slot = np.nonzero(edges >= 0)
    target = edges[source, slot]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    order = np.lexsort((-np.einsum("ij,ij->i", units[a], units[b]), a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    wide = np.full((len(edges), 3 * degree), -1)
    use = place < wide.shape[1]
    wide[a[use], place[use]] = b[use]
    out = np.empty_like(edges)
    for at in range(0, len(edges), block):
        of = np.arange(at, min(at + block, len(edges)))
        out[of] = robust_prune(units, of, wide[of], degree, relax)
    return out


def entry_nodes(units: np.ndarray, count: int) -> np.ndarray:
    """The middle node, and then always the node that is farthest from those taken."""
    taken = [int((units @ units.mean(0)).argmax())]
    near = units @ units[taken[0]]
    while len(taken) < min(count, len(units)):
        near[taken] = np.inf
        taken.append(int(near.argmin()))
        near = np.maximum(near, units @ units[taken[-1]])
    return np.array(taken)


def reached(edges: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Of every node, whether edges lead to it from one of the entries."""
    seen = np.zeros(len(edges) + 1, bool)
    seen[entries] = seen[-1] = True
    while len(entries):
        entries = np.unique(edges[entries])
        entries = entries[~seen[entries]]
        seen[entries] = True
    return seen[:-1]


def _linked(units: np.ndarray, edges: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Edges with one more, from the nearest node reached, for every part that no entry reaches."""
    seen = reached(edges, entries)
    while not seen.all():
        node = int(seen.argmin())
        near = int(np.where(seen, units @ units[node], -np.inf).argmax())
        if (edges[near] >= 0).all():
            edges = np.concatenate([edges, np.full((len(edges), 1), -1)], 1)
        edges[near, (edges[near] < 0).argmax()] = node
        seen |= reached(edges, np.array([node]))
    return edges


def build_graph(units: np.ndarray, form: Graphs, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries): directed edges of all nodes, -1 where there are fewer, and where searches start."""
    rng, count = np.random.default_rng(form.seed), len(units)
    entries = entry_nodes(units, form.entries)
    degree = min(form.degree, max(1, count - 1))
    edges = rng.integers(0, count, (count, degree))
    random = rng.integers(0, count, (count, min(form.random, degree)))
    for turn in range(form.rounds):
        new, searched = np.full((count, degree), -1), np.concatenate([edges, random], 1)
        relax = form.relax if turn else 1.0
        for at in range(0, count, block):
            of = np.arange(at, min(at + block, count))
            found, _ = beam_search(units, searched, units[of], entries, form.beam)
            new[of] = robust_prune(units, of, np.concatenate([found, edges[of]], 1), degree, relax)
        edges = _with_reverse(units, new, degree, relax, block)
    return _linked(units, np.concatenate([edges, random], 1), entries), entries


_INDEX = "shard int, width int, entries binary, ids binary, rows binary, nodes binary, vectors binary, edges binary"


def build_index(vectors: DataFrame, size: int, form: Graphs) -> DataFrame:
    """A row per shard: ids and row numbers by node, the nodes' vectors and their edges."""
    shards = max(1, -(-vectors.count() // form.shard_rows))

    def build(rows: pa.Table) -> pa.Table:
        ids, numbers, values = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), matrix(rows["v"], size)
        order = np.lexsort((numbers, ids))
        distinct, node = np.unique(values[order], axis=0, return_inverse=True)
        by_node = np.argsort(node.ravel(), kind="stable")
        counts = np.bincount(node.ravel())
        edges, entries = build_graph(_units(distinct).astype(np.float32), form)
        blobs = [entries.astype(np.int64), ids[order][by_node], numbers[order][by_node], counts.astype(np.int64), distinct, edges.astype(np.int32)]
        values = [[rows["shard"][0].as_py()], [size], *[[b.tobytes()] for b in blobs]]
        kinds = [pa.int32()] * 2 + [pa.binary()] * 6
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _INDEX.split(", ")])

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, _INDEX)


def _units(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def search_index(index: DataFrame, queries_path: str, size: int, k: int, form: Graphs) -> DataFrame:
    """(query_row, query_id, vec_id, score): every shard's best hits of every query in the table at the path."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_store(queries_path)
        files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(folder)) if f.path.endswith(".parquet"))
        for batch in batches:
            for row in batch.to_pylist():
                ids, numbers, counts = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "nodes"))
                values = np.frombuffer(row["vectors"]).reshape(-1, size)
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(values), -1)
                entries = np.frombuffer(row["entries"], np.int64)
                units, first = _units(values), np.cumsum(counts) - counts
                small = units.astype(np.float32)
                for name in files:
                    with fs.open_input_file(name) as file:
                        for asked in pa.parquet.ParquetFile(file).iter_batches(256, columns=["row", "vec_id", "v"]):
                            query_ids, wanted = [asked.column(c).to_numpy() for c in ("row", "vec_id")], _units(matrix(asked.column("v"), size))
                            nodes, _ = beam_search(small, edges, wanted.astype(np.float32), entries, min(form.wide_beam, len(values)))
                            yield _hits(*query_ids, wanted, nodes, units, ids, numbers, counts, first)

    def _hits(query_rows, query_ids, wanted, nodes, units, ids, numbers, counts, first) -> pa.RecordBatch:
        query, slot = np.nonzero(nodes >= 0)
        node = nodes[query, slot]
        # A node's ids are in order, so the first k + 1 are enough: one of them may be the query itself.
        many = np.minimum(counts[node], k + 1)
        score = np.repeat(np.einsum("ij,ij->i", wanted[query], units[node]), many)
        query, place = np.repeat(query, many), ranges(many, first[node])
        other = numbers[place] != query_rows[query]
        query, found, score = query[other], ids[place[other]], score[other]
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < k
        columns = [query_rows[query[best]], query_ids[query[best]], found[best], score[best]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    tasks = max(1, index.count())
    return index.repartition(tasks).mapInArrow(search, "query_row long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, form: Graphs = Graphs()) -> DataFrame:
    """(query_id, rank, vec_id, score): cosine of the k nearest rows found for each ``every``-th id."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors, nonzero=True), "vectors")
    size = width(rows)
    index = staged(build_index(rows, size, form), "graph-index")
    path = scratch_path(spark, "queries")
    rows.where(F.col("vec_id") % every == 0).write.parquet(path)
    hits = search_index(index, path, size, k, form)
    return ranked(hits, k, [F.desc("score"), F.col("vec_id")])
