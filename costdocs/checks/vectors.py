"""Registered queries over vectors. The queries are the mean vectors of all labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.checks.fixtures import centroids, corpus, corpus_texts, table, with_vectors
from costdocs.checks.registry import register
from costdocs.functions.scores import cosine, rescale
from costdocs.operators import dedup, search

K, N = search.TOP_K, search.TOP_N
GATE = 0.6


def hits(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return search.top_k(corpus(spark, sf_dir), centroids(spark, sf_dir), k)


# Ranks follow the whole scores in both engines; only what is shown is rounded.
SHOWN = "query_id, id, round(raw_score, 6) + 0.0 AS raw_score, rank"


def shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw_score", F.round("raw_score", 6) + 0.0)


def own_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = centroids(spark, sf_dir).select(F.col("query_id").alias("label"), F.col("embedding").alias("mean"))
    joined = table(spark, sf_dir, "embeddings").join(means, "label")
    return joined.select("vec_id", "label", (F.round(cosine(F.col("embedding"), F.col("mean")), 6) + 0.0).alias("similarity"))


register(
    "j01_similarity",
    own_centroid,
    with_vectors(
        "SELECT id AS vec_id, label, round(raw_score, 6) + 0.0 AS similarity FROM pairs JOIN embeddings ON id = vec_id AND label = query_id", K
    ),
)
register(
    "j02_top_k",
    lambda s, d: shown(hits(s, d)),
    with_vectors(f"SELECT {SHOWN} FROM hits", K),
)
register(
    "c05_neighbour_join",
    lambda s, d: shown(
        search.top_k(table(s, d, "embeddings").select("vec_id", "embedding"), centroids(s, d), 5, max_local_queries=0, block_bytes=1 << 10)
    ),
    with_vectors(f"SELECT {SHOWN} FROM hits", 5),
)
register(
    "j03_score_normalise",
    lambda s, d: hits(s, d).select("query_id", "id", F.round(rescale(F.col("raw_score")), 6).alias("score")),
    with_vectors("SELECT query_id, id, round(score, 6) AS score FROM scored", K),
)
register(
    "d14_mean_score",
    lambda s, d: search.average_scores(centroids(s, d), hits(s, d)).withColumn("avg_score", F.round("avg_score", 6)),
    with_vectors("SELECT query_id, round(avg(score), 6) AS avg_score FROM scored GROUP BY 1", K),
)
register(
    "j04_mean_gate",
    lambda s, d: search.gated(hits(s, d), GATE).select("query_id", "id", "rank", F.round("avg_score", 6).alias("avg_score")),
    with_vectors(
        f"SELECT query_id, id, rank, round(avg_score, 6) AS avg_score FROM scored WHERE avg_score >= {GATE} AND rank <= {N}", K
    ),
)
register(
    "f03_top_k_then_top_n",
    lambda s, d: search.gated(hits(s, d), 0.0).select("query_id", "id", "rank"),
    with_vectors(f"SELECT query_id, id, rank FROM hits WHERE rank <= {N}", K),
)

_ID_SQL = "coalesce(nullif(texts.id, ''), nullif(chunk_id, ''), concat('doc-', cast(rank - 1 AS varchar)))"


def _context_sql(threshold: float, n: int) -> str:
    return (
        f"SELECT query_id, rank, {_ID_SQL} AS id, md5(text) AS text_md5, round(score, 6) AS score, coalesce(title, '') AS title,"
        " coalesce(section, '') AS section, coalesce(source, 'aws-doc') AS source, 'developer-guide' AS doc_type"
        f" FROM scored JOIN texts ON scored.id = vec_id WHERE avg_score >= {threshold} AND rank <= {n}"
    )


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "query_id",
        "rank",
        "id",
        F.md5("text").alias("text_md5"),
        F.round("score", 6).alias("score"),
        "metadata.title",
        "metadata.section",
        "metadata.source",
        "metadata.doc_type",
    )


register(
    "j05_context_rows",
    lambda s, d: _flat(search.retrieve(corpus(s, d), centroids(s, d), corpus_texts(s, d))),
    with_vectors(_context_sql(search.THRESHOLD, N), K),
)
register(
    "j06_search",
    lambda s, d: _flat(search.search(corpus(s, d), centroids(s, d), corpus_texts(s, d), 5)),
    with_vectors(_context_sql(0.0, 5), 10),
)



def contexts_without_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every query's contexts those that start like none before; another query's do not count."""
    rows = search.search(corpus(spark, sf_dir), centroids(spark, sf_dir), corpus_texts(spark, sf_dir), N)
    return dedup.dedup_by_prefix(rows, "text", ["rank"], 3, ["query_id"]).select("query_id", "rank", "id")


register(
    "g02_context_prefix_dedup",
    contexts_without_copies,
    with_vectors(
        f"""SELECT query_id, rank, {_ID_SQL} AS id FROM scored JOIN texts ON scored.id = vec_id WHERE rank <= {N}
 QUALIFY row_number() OVER (PARTITION BY query_id, trim(left(text, 3), chr(32) || chr(9) || chr(10) || chr(13)) ORDER BY rank) = 1""",
        2 * N,
    ),
)
register(
    "j07_context_text",
    lambda s, d: search.relevant_context(corpus(s, d), centroids(s, d), corpus_texts(s, d)),
    with_vectors(
        f"""SELECT q.query_id AS query_id, coalesce(string_agg(concat('제목: ', coalesce(title, ''), chr(10), '섹션: ', coalesce(section, ''), chr(10),
 '내용: ', coalesce(text, ''), chr(10), '---'), chr(10) ORDER BY rank) FILTER (WHERE rank IS NOT NULL), '') AS context
 FROM queries q LEFT JOIN (SELECT * FROM scored JOIN texts ON scored.id = vec_id WHERE avg_score >= {search.THRESHOLD} AND rank <= 3) c
 ON q.query_id = c.query_id GROUP BY 1""",
        6,
    ),
)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, found = centroids(spark, sf_dir), hits(spark, sf_dir)
    rows = search.contexts(found, corpus_texts(spark, sf_dir), GATE)
    out = search.retrieval_report(asked, found, rows)
    return out.withColumn("context_ids", F.concat_ws(",", "context_ids")).withColumn("avg_score", F.round("avg_score", 6))


register(
    "j08_retrieval_report",
    report,
    with_vectors(
        f"""SELECT q.query_id AS query_id, (SELECT round(avg(score), 6) FROM scored s WHERE s.query_id = q.query_id) AS avg_score,
 {K} AS top_k, {N} AS top_n, count(c.rank) AS contexts,
 coalesce(array_to_string((list(c.cid ORDER BY c.rank) FILTER (WHERE c.rank IS NOT NULL))[1:3], ','), '') AS context_ids
 FROM queries q LEFT JOIN (SELECT scored.query_id AS query_id, rank, {_ID_SQL} AS cid FROM scored JOIN texts ON scored.id = vec_id
  WHERE avg_score >= {GATE} AND rank <= {N}) c ON q.query_id = c.query_id GROUP BY 1""",
        K,
    ),
)
register(
    "j09_score_report",
    lambda s, d: shown(search.score_report(hits(s, d, 5))).withColumn("similarity", F.round("similarity", 6)),
    with_vectors(
        f"""SELECT {SHOWN}, round(1 - (1 - raw_score) / 2, 6) AS similarity,
 CASE WHEN 1 - (1 - raw_score) / 2 >= 0.8 THEN 'very high' WHEN 1 - (1 - raw_score) / 2 >= 0.6 THEN 'high'
 WHEN 1 - (1 - raw_score) / 2 >= 0.4 THEN 'medium' ELSE 'low' END AS grade FROM hits""",
        5,
    ),
)
