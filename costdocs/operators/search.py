"""Exact vector search for a table of queries.

Every task keeps the best ``k`` hits per query while it scans, so what is shuffled is small
rows, never one row per query and corpus vector, and never a corpus vector. The query vectors
travel to the corpus tasks as one matrix as long as their counted rows and bytes allow it, which
gives (tasks x queries x k) rows. Of larger query tables the vectors of both sides are written to
the shared folder, the queries in blocks, and a task reads one block and past it the corpus, so
that (queries x k) rows are shuffled, however large the corpus is; it is cut into shards only
where the blocks are too few for the cores, or where it is very long.

Scores are not rounded: candidates are found by matrix products of single precision, whose
error is bounded, and each is then scored again by itself in double precision, so that equal
vectors get equal scores wherever they lie. Work grows with queries times rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.functions.scores import grade, rescale, similarity_from_distance
from costdocs.functions.text import first_filled
from costdocs.operators.joins import bounded_copy, observed, weigh
from costdocs.operators.ranking import first_rows
from costdocs.sources.scratch import open_files, scratch_path

MAX_LOCAL_QUERIES = 4096  # query vectors that are sent whole to every task,
BLOCK_BYTES = 64 << 20  # if they have at most so many bytes; also those of one block
BLOCK_ROWS = 16_384  # queries of one block at most, and for few queries
LEAST_ROWS = 1024  # on many cores about so many at least
BLOCK_HITS = 1 << 20  # hits that a block keeps
SHARD_ROWS = 1 << 24  # of the corpus that a task reads for its block
MAX_HIT_ROWS = 1_000_000  # hits up to this many rows are sent to the tasks that hold the texts
READ_BYTES = 32 << 20  # unit rows of the corpus that a task holds while it reads
CELLS = 1 << 20  # scores held at a time while scanning

# Defaults of the retrieval calls and of a context's metadata.
TOP_K, TOP_N, THRESHOLD = 20, 8, 0.35
CONTEXT_DEFAULTS = {
    "title": "",
    "section": "",
    "url": "",
    "version_date": "",
    "source": "aws-doc",
    "doc_type": "developer-guide",
}
CONTEXT_LABELS = ("제목: ", "섹션: ", "내용: ")
CONTEXT_RULE = "---"


def _plain(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as they are: whole numbers, or texts as Python objects. They hold no nulls."""
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _places(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids."""
    return np.unique(ids, return_inverse=True)[1].ravel() if ids.dtype == object else ids


def _unit_rows(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of unit rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.empty((0, 0))
    lengths = np.diff(vectors.offsets.to_numpy())
    if lengths.min() != lengths.max():
        raise ValueError("all vectors must have the same length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(vectors), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _longest(matrix: np.ndarray) -> float:
    """The length of the longest row, 1 at least; rounding makes very small vectors longer than 1."""
    return math.sqrt(np.einsum("ij,ij->i", matrix, matrix).max(initial=1.0))


def _true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the few true values of a mask, which are looked for eight at a time."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.nonzero(mask)
    words = np.flatnonzero(flat.view(np.uint64))
    word, byte = np.nonzero(flat.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + byte, mask.shape[1])


def _order(query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hits by query, falling score and id; ids are compared only where scores are equal."""
    order = np.lexsort((-score, query))
    tied = np.zeros(len(order) + 1, bool)
    tied[1:-1] = (np.diff(query[order]) == 0) & (np.diff(score[order]) == 0)
    some = np.flatnonzero(tied[:-1] | tied[1:])
    if len(some):
        equals, hits = np.cumsum(~tied[:-1])[some], order[some]
        order[some] = hits[np.lexsort((_places(ids[hits]), equals))]
    return order


class _Best:
    """The ``k`` best hits of every query so far; equal scores go to the smaller id.

    Products of single precision, which are off by less than the slack, find the pairs that may reach
    their query's border; these alone are scored in double precision.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.single = queries.astype(np.float32)
        self.slack = (queries.shape[1] + 8) * float(np.finfo(np.float32).eps) * _longest(queries)
        self.border = np.full(len(queries), -np.inf)  # what a hit must reach to matter
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (query, score, id)
        self.waiting = 0

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        tall = max(1, min(len(self.queries), math.isqrt(CELLS)))
        wide = max(1, min(len(ids), CELLS // tall))
        held, slack = np.empty(tall * wide, np.float32), self.slack * _longest(matrix)
        for at in range(0, len(ids), wide):
            rows = matrix[at : at + wide]
            turned = np.ascontiguousarray(rows.T, dtype=np.float32)
            for first in range(0, len(self.queries), tall):
                query, row = self._near(slice(first, first + tall), turned, slack, held)
                self._score(query + first, row, ids[at : at + wide], rows)

    def _near(self, some: slice, turned: np.ndarray, slack: float, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of a tile's pairs that may reach the queries' borders."""
        single, border, width = self.single[some], self.border[some], turned.shape[1]
        products = np.matmul(single, turned, out=held[: len(single) * width].reshape(len(single), width))
        if width >= self.k and np.isneginf(border).any():
            # So many rows of the tile score as much at least.
            np.maximum(border, np.partition(products, -self.k, axis=1)[:, -self.k] - slack, out=border)
        reach = (border - slack).astype(np.float32)
        hot = np.flatnonzero(products.max(axis=1) >= reach)
        query, row = _true(products[hot] >= reach[hot, None])
        return hot[query], row

    def _score(self, query: np.ndarray, row: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        step = max(1, CELLS // max(1, rows.shape[1]))
        for at in range(0, len(query), step):
            q, r = query[at : at + step], row[at : at + step]
            score = np.einsum("ij,ij->i", self.queries[q], rows[r]) + 0.0
            kept = score >= self.border[q]
            self.found.append((q[kept], score[kept], ids[r[kept]]))
            self.waiting += int(kept.sum())
            if self.waiting >= max(CELLS // 8, self.k * len(self.queries)):
                self._merge()

    def _merge(self) -> None:
        query, score, ids = (np.concatenate(parts) for parts in zip(*self.found))
        order = _order(query, score, ids)
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.k - 1
        self.border[query[full]] = score[full]
        kept = place < self.k
        self.found = [(query[kept], score[kept], ids[kept])]
        self.waiting = 0

    def table(self, query_ids: np.ndarray, schema: pa.Schema) -> pa.Table:
        if not self.found:
            return schema.empty_table()
        self._merge()
        query, score, ids = self.found[0]
        columns = [query_ids[query], ids, score]
        return pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StringType):
        return pa.string()
    if isinstance(kind, T.IntegerType):
        return pa.int32()
    return pa.int64()


def _local_scan(query_ids: np.ndarray, matrix: np.ndarray, k: int, schema: pa.Schema) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(matrix, k)
        for batch in batches:
            if batch.num_rows:
                best.add(_plain(batch.column(0)), _unit_rows(batch.column(1)))
        yield from best.table(query_ids, schema).to_batches()

    return scan


def _block_scan(asked: str, corpus: str, shards: int, k: int, schema: pa.Schema) -> Callable:
    """The scan of tasks that are numbers: each reads its block of queries, and past it its shard of the corpus."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (number for batch in batches for number in batch.column(0).to_pylist()):
            fs, files = open_files(asked, recursive=True)
            block = [name for name in files if f"/_block={task // shards}/" in name]
            if not block:
                continue
            queries = pa.concat_tables([pa.parquet.read_table(name, filesystem=fs, partitioning=None) for name in block])
            matrix = _unit_rows(queries["query_vector"])
            best, rows = _Best(matrix, k), max(1, READ_BYTES // (8 * max(1, matrix.shape[1])))
            fs, files = open_files(corpus)
            for name in files[task % shards :: shards]:
                with fs.open_input_file(name) as file:
                    for part in pa.parquet.ParquetFile(file).iter_batches(rows, columns=["id", "vector"]):
                        best.add(_plain(part.column("id")), _unit_rows(part.column("vector")))
            yield from best.table(_plain(queries["query_id"]), schema).to_batches()

    return scan


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    corpus_id: str = "vec_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    max_local_queries: int = MAX_LOCAL_QUERIES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` corpus rows with the highest cosine per query: (query_id, id, raw_score, rank).

    Rows without an id, without a vector, or whose vector holds a null or no finite number take no
    part; the smaller of equal scores' ids comes first.
    """
    left = _whole(corpus, vector).select(F.col(corpus_id).alias("id"), F.col(vector).alias("vector")).where("id is not null")
    right = _whole(queries, vector).select(F.col(query_id).alias("query_id"), F.col(vector).alias("query_vector")).where("query_id is not null")
    kinds = {"query_id": right.schema["query_id"].dataType, "id": left.schema["id"].dataType}
    schema = pa.schema([*((name, _arrow(kind)) for name, kind in kinds.items()), ("raw_score", pa.float64())])
    out = T.StructType([*(T.StructField(n, t) for n, t in kinds.items()), T.StructField("raw_score", T.DoubleType())])

    order = [F.desc("raw_score"), F.col("id")]
    small = bounded_copy(right, max_local_queries, block_bytes)
    if small is None:
        # A query's hits come from one task, or one for each shard, so they need no merging before they are ranked.
        hits = _block_hits(left, right, k, schema, out, block_bytes)
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    head = small.toArrow()
    hits = left.mapInArrow(_local_scan(_plain(head["query_id"]), _unit_rows(head["query_vector"]), k, schema), out)
    ranked = first_rows(hits, k, order, ["query_id"])
    # The number of hits is known here: a few of them go to the tables they are joined with. Hits with ids of any
    # length are weighed when the join runs.
    fixed = not any(isinstance(kind, T.StringType) for kind in kinds.values())
    return F.broadcast(ranked) if fixed and head.num_rows * k <= MAX_HIT_ROWS else ranked


def _whole(table: DataFrame, vector: str) -> DataFrame:
    """The rows whose vectors are there and hold finite numbers only."""
    return table.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _grid(queries: int, size: int, rows: int, files: int, k: int, cores: int, block_bytes: int) -> tuple[int, int]:
    """Numbers of blocks of queries and of shards of the corpus; more of either only as memory, cores or long tasks ask for."""
    hits = queries * min(k, max(1, rows))
    least = max(-(-size // block_bytes), -(-queries // BLOCK_ROWS), -(-hits // BLOCK_HITS), 1)
    blocks = max(least, min(2 * cores, -(-queries // LEAST_ROWS)))
    blocks = blocks if blocks <= cores else -(-blocks // cores) * cores  # no cores idle at the end
    return blocks, max(1, min(files, max(-(-2 * cores // blocks), -(-rows // SHARD_ROWS))))


def _block_hits(left: DataFrame, right: DataFrame, k: int, schema: pa.Schema, out: T.StructType, block_bytes: int) -> DataFrame:
    """Hits of a large query table: a task for every block of queries and shard of the corpus, whose vectors are written as they lie."""
    spark, seen = left.sparkSession, Observation()
    corpus, asked = scratch_path(spark, "corpus-vectors"), scratch_path(spark, "query-blocks")
    left.observe(seen, F.count("*").alias("rows")).write.parquet(corpus)
    queries, size = weigh(right)
    cores = spark.sparkContext.defaultParallelism
    blocks, shards = _grid(queries, size, observed(seen).get("rows", 0), len(open_files(corpus)[1]), k, cores, block_bytes)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    right.withColumn("_block", block).repartition("_block").write.partitionBy("_block").parquet(asked)
    # Numbers from an RDD: a range's few bytes would be taken for the size of the hits, which then are sent whole where they are joined.
    numbers = spark.sparkContext.parallelize(range(blocks * shards), blocks * shards)
    tasks = spark.createDataFrame(numbers.map(lambda number: (number,)), "task long", verifySchema=False)
    return tasks.mapInArrow(_block_scan(asked, corpus, shards, k, schema), out)


def scored(hits: DataFrame) -> DataFrame:
    """Scores rescaled to [0, 1] and their mean per query over all ``k`` hits."""
    per_query = Window.partitionBy("query_id")
    return hits.withColumn("score", rescale(F.col("raw_score"))).withColumn(
        "avg_score", F.avg("score").over(per_query)
    )


def gated(hits: DataFrame, threshold: float = THRESHOLD, top_n: int = TOP_N) -> DataFrame:
    """The first ``top_n`` hits of the queries whose mean score reaches the threshold."""
    return scored(hits).where((F.col("avg_score") >= threshold) & (F.col("rank") <= top_n))


def average_scores(queries: DataFrame, hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Mean score of every query, 0 without hits."""
    means = hits.groupBy("query_id").agg(F.avg(rescale(F.col("raw_score"))).alias("_avg"))
    asked = queries.select(F.col(query_id).alias("query_id"))
    return asked.join(means, "query_id", "left").select("query_id", F.coalesce("_avg", F.lit(0.0)).alias("avg_score"))


def contexts(
    hits: DataFrame,
    texts: DataFrame,
    threshold: float = THRESHOLD,
    top_n: int = TOP_N,
    text: str = "text",
    key: str = "vec_id",
) -> DataFrame:
    """Context rows (query_id, rank, id, text, score, metadata) of the gated hits.

    ``texts`` has the corpus key, the text and any of ``id``, ``chunk_id`` and the metadata
    columns. Hits within the bound of :func:`top_k` are sent to the texts, which then need no
    shuffle.
    """
    chosen = gated(hits, threshold, top_n).withColumnRenamed("id", "_hit")
    have = set(texts.columns)
    names = [F.col(c) if c in have else F.lit(None).cast("string") for c in ("id", "chunk_id")]
    metadata = [
        (F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)).alias(c) for c, d in CONTEXT_DEFAULTS.items()
    ]
    return texts.join(chosen, texts[key] == chosen["_hit"]).select(
        "query_id",
        "rank",
        first_filled(*names, F.concat(F.lit("doc-"), (F.col("rank") - 1).cast("string"))).alias("id"),
        F.col(text).alias("text"),
        "score",
        F.struct(*metadata).alias("metadata"),
    )


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    texts: DataFrame,
    k: int = TOP_K,
    top_n: int = TOP_N,
    threshold: float = THRESHOLD,
    text: str = "text",
    key: str = "vec_id",
) -> DataFrame:
    """Contexts of every query: top ``k``, mean gate, first ``top_n``; ``key`` is in both tables, once per row."""
    return contexts(top_k(corpus, queries, k, key), texts, threshold, top_n, text, key)


def search(corpus: DataFrame, queries: DataFrame, texts: DataFrame, top_n: int = 5, text: str = "text") -> DataFrame:
    """Contexts without a gate, from twice as many candidates."""
    return retrieve(corpus, queries, texts, 2 * top_n, top_n, 0.0, text)


def search_store(
    store: DataFrame, queries: DataFrame, k: int = TOP_K, top_n: int = TOP_N, threshold: float = THRESHOLD
) -> DataFrame:
    """:func:`retrieve` over a stored chunk table (``text_hash``, ``id``, ``content``, ``embedding``, metadata).

    Chunks are told apart by the hash of their text, which the store holds once; ids are made of a
    page's file name and may occur again.
    """
    return retrieve(store, queries, store.drop("embedding"), k, top_n, threshold, "content", "text_hash")


def retrieval_report(
    queries: DataFrame,
    hits: DataFrame,
    context_rows: DataFrame,
    k: int = TOP_K,
    top_n: int = TOP_N,
    query_id: str = "query_id",
) -> DataFrame:
    """One row per query: mean score, parameters and the first three context ids."""
    first = context_rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("_ids"), F.count("*").alias("_n")
    )
    none = F.array().cast("array<string>")
    return (
        average_scores(queries, hits, query_id)
        .join(first, "query_id", "left")
        .select(
            "query_id",
            "avg_score",
            F.lit(k).alias("top_k"),
            F.lit(top_n).alias("top_n"),
            F.coalesce("_n", F.lit(0)).alias("contexts"),
            F.coalesce(F.slice("_ids.id", 1, 3), none).alias("context_ids"),
        )
    )


def context_text(queries: DataFrame, context_rows: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The contexts of a query as one text, '' without any; a query has at most top_n of them."""
    title, section, content = CONTEXT_LABELS
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit(title), F.col("metadata.title")),
        F.concat(F.lit(section), F.col("metadata.section")),
        F.concat(F.lit(content), F.coalesce("text", F.lit(""))),
        F.lit(CONTEXT_RULE),
    )
    texts = context_rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", lines.alias("lines")))).alias("_parts")
    )
    asked = queries.select(F.col(query_id).alias("query_id"))
    return asked.join(texts, "query_id", "left").select(
        "query_id", F.coalesce(F.array_join("_parts.lines", "\n"), F.lit("")).alias("context")
    )


def relevant_context(corpus: DataFrame, queries: DataFrame, texts: DataFrame, top_n: int = 3) -> DataFrame:
    """Context text per query from ``2 * top_n`` candidates, gated."""
    return context_text(queries, retrieve(corpus, queries, texts, 2 * top_n, top_n))


def score_report(hits: DataFrame) -> DataFrame:
    """Similarity from cosine distance, and its grade."""
    similarity = similarity_from_distance(F.lit(1.0) - F.col("raw_score"))
    return hits.withColumn("similarity", similarity).withColumn("grade", grade(F.col("similarity")))
