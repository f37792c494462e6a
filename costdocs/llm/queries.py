"""The numbered operators as queries over whole tables, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from costdocs.llm import (
    graph_search,
    language_mixture,
    mixing,
    packing,
    periodic_runs,
    perspectives,
    planes,
    prefix_trie,
    revisits,
    simhash,
    suffix_tree,
    toxicity,
    voronoi,
)
from costdocs.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.plane_digest(spark, table(spark, sf_dir, "documents"))


@query
def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.deduplicated(spark, table(spark, sf_dir, "pages"))


ORACLES["op2_revisit_resolution"] = revisits.ORACLE


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op4_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(table(spark, sf_dir, "embeddings"))


@query
def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, toxicity.graded_labels(table(spark, sf_dir, "labels"))))


@query
def op6_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.suffix_tree_scores(table(spark, sf_dir, "documents"))


@query
def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.views(table(spark, sf_dir, "conversations"))


ORACLES["op8_perspective_rotation"] = perspectives.ORACLE


@query
def op9_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query
def op10_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.voronoi_top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op10_voronoi_join"] = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(x.e AS DOUBLE[])) AS BIGINT) AS score
 FROM v q JOIN v x ON q.n <> x.n WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


@query
def op11_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.predicted_languages(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = prefix_trie.ORACLE


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.with_planted_period)
