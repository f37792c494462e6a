import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costdocs.functions.scores import cosine, grade, rescale, similarity_from_distance
from costdocs.operators import search

rng = np.random.default_rng(7)
CORPUS = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 60, axis=0)])
QUERIES = np.concatenate([rng.normal(size=(6, 8)), CORPUS[300:301]])


def vectors(spark, matrix, key, parts=5, make=int):
    rows = [(make(i), [float(x) for x in v]) for i, v in enumerate(matrix)]
    kind = "string" if make is not int else "long"
    return spark.createDataFrame(rows, f"{key} {kind}, embedding array<double>").repartition(parts)


def brute_force(k, name=int):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    corpus = unit(CORPUS)
    scores = [np.einsum("ij,ij->i", np.repeat(q[None, :], len(corpus), axis=0), corpus) for q in unit(QUERIES)]
    return {
        (q, name(i), rank)
        for q, row in enumerate(scores)
        for rank, i in enumerate(sorted(range(len(row)), key=lambda i: (-row[i], name(i)))[:k], 1)
    }


def found(hits):
    return {(r["query_id"], r["id"], r["rank"]) for r in hits.collect()}


@pytest.mark.parametrize("k", [1, 7, 70, 500])
@pytest.mark.parametrize("options", [{}, {"max_local_queries": 3, "block_bytes": 8 * 8 * 50}])
def test_top_k_equals_brute_force(spark, k, options):
    hits = search.top_k(vectors(spark, CORPUS, "vec_id"), vectors(spark, QUERIES, "query_id", 2), k, **options)
    assert found(hits) == brute_force(k)


def test_text_ids_and_missing_vectors(spark):
    name = "c{:03d}".format
    corpus = vectors(spark, CORPUS, "vec_id", make=name).union(
        spark.createDataFrame([("none", None)], "vec_id string, embedding array<double>")
    )
    hits = search.top_k(corpus, vectors(spark, QUERIES, "query_id"), 5)
    assert found(hits) == brute_force(5, name)


def test_small_scan_steps_give_the_same(spark, monkeypatch):
    whole = search._Best(QUERIES / np.linalg.norm(QUERIES, axis=1, keepdims=True), 9)
    steps = search._Best(whole.queries, 9)
    unit = CORPUS / np.linalg.norm(CORPUS, axis=1, keepdims=True)
    whole.add(np.arange(len(unit)), unit)
    monkeypatch.setattr(search, "CELLS", 20)
    for at in range(0, len(unit), 50):
        steps.add(np.arange(at, min(at + 50, len(unit))), unit[at : at + 50])
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    names = np.arange(len(QUERIES))
    assert whole.table(names, schema).equals(steps.table(names, schema))
    assert whole.table(names, schema).num_rows == 9 * len(QUERIES)


def test_unequal_vectors_are_an_error(spark):
    corpus = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="same length"):
        search.top_k(corpus, queries, 1).collect()


@pytest.mark.parametrize("raw, score", [(-0.4, 0.3), (-0.3, 0.35), (0.0, 0.5), (0.4, 0.7), (-3.0, 0.0), (9.0, 1.0)])
def test_rescale(spark, raw, score):
    assert spark.range(1).select(rescale(F.lit(raw))).first()[0] == pytest.approx(score)


@pytest.mark.parametrize("similarity, band", [(0.8, "very high"), (0.79, "high"), (0.6, "high"), (0.4, "medium"), (0.39, "low")])
def test_grades(spark, similarity, band):
    assert spark.range(1).select(grade(F.lit(similarity))).first()[0] == band


def test_similarity_and_cosine(spark):
    row = spark.range(1).select(
        similarity_from_distance(F.lit(0.55)).alias("s"),
        cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"),
        cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
    ).first()
    assert row["s"] == pytest.approx(0.725) and row["c"] == pytest.approx(0.5**0.5) and row["z"] == 0.0


@pytest.fixture
def small(spark):
    corpus = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>"
    )
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, -1.0])], "query_id long, embedding array<double>")
    texts = spark.createDataFrame(
        [(0, "t0", "a", None, "T0", None), (1, "t1", "", "c1", None, ""), (2, "t2", None, "", None, None), (3, None, None, None, None, None)],
        "vec_id long, text string, id string, chunk_id string, title string, source string",
    )
    return corpus, queries, texts


def test_gate_uses_the_mean_of_all_k(spark, small):
    corpus, queries, _ = small
    hits = search.top_k(corpus, queries, 3)
    means = {r["query_id"]: r["avg_score"] for r in search.average_scores(queries, hits).collect()}
    assert means[0] > 0.8 and 0.4 < means[1] < 0.5
    assert {r["query_id"] for r in search.gated(hits, 0.6, 1).collect()} == {0}
    assert found(search.gated(hits, 0.0, 1)) == {(0, 0, 1), (1, 0, 1)}


def test_context_rows_fill_missing_ids_and_metadata(spark, small):
    corpus, queries, texts = small
    rows = {(r["query_id"], r["rank"]): r for r in search.retrieve(corpus, queries, texts, 4, 4, 0.0).collect()}
    assert [rows[0, i]["id"] for i in (1, 2, 3, 4)] == ["a", "c1", "doc-2", "doc-3"]
    first, second = rows[0, 1]["metadata"], rows[0, 2]["metadata"]
    assert (first["title"], first["source"], first["doc_type"]) == ("T0", "aws-doc", "developer-guide")
    assert (second["title"], second["source"], second["section"]) == ("", "", "")


def test_report_and_text_keep_queries_without_contexts(spark, small):
    corpus, queries, texts = small
    hits = search.top_k(corpus, queries, 3)
    rows = search.contexts(hits, texts, 0.6, 2)
    report = {r["query_id"]: r for r in search.retrieval_report(queries, hits, rows, 3, 2).collect()}
    assert report[0]["context_ids"] == ["a", "c1"] and report[0]["contexts"] == 2
    assert report[1]["context_ids"] == [] and report[1]["avg_score"] > 0
    text = {r["query_id"]: r["context"] for r in search.context_text(queries, rows).collect()}
    assert text[1] == ""
    assert text[0] == "제목: T0\n섹션: \n내용: t0\n---\n제목: \n섹션: \n내용: t1\n---"


def test_no_corpus_gives_mean_zero(spark, small):
    corpus, queries, _ = small
    hits = search.top_k(corpus.limit(0), queries, 3)
    assert {r["avg_score"] for r in search.average_scores(queries, hits).collect()} == {0.0}


def test_search_asks_for_twice_as_many(spark, small):
    corpus, queries, texts = small
    assert search.search(corpus, queries, texts, 1).count() == 2


def test_scores_are_not_rounded_before_ranking(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0008]), (2, [1.0, 0.0]), (3, [1.0, 0.0001])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    for options in ({}, {"max_local_queries": 0}):
        hits = search.top_k(corpus, queries, 3, **options).orderBy("rank").collect()
        assert [r["id"] for r in hits] == [2, 3, 1]
        assert hits[0]["raw_score"] - hits[1]["raw_score"] == pytest.approx(5e-9, rel=1e-3)


def test_rows_without_an_id_or_a_number_take_no_part(spark):
    big = 2**53 + 1
    rows = [(None, [1.0, 0.0]), (big, [1.0, 0.1]), (5, [1.0, float("nan")]), (6, [1.0, None]), (7, None), (big + 1, [1.0, 0.2])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (None, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in search.top_k(corpus, queries, 9).orderBy("rank").collect()] == [(0, big), (0, big + 1)]
    named = corpus.select(F.concat(F.lit("id"), F.col("vec_id").cast("string")).alias("vec_id"), "embedding")
    assert [r["id"] for r in search.top_k(named, queries, 9).orderBy("rank").collect()] == [f"id{big}", f"id{big + 1}"]


def test_block_search_leaves_the_corpus_where_it_is(spark):
    corpus, queries = vectors(spark, CORPUS, "vec_id").select("vec_id", "embedding"), vectors(spark, QUERIES, "query_id", 2)
    path = spark.conf.get("spark.checkpoint.dir") + "/test-corpus-" + str(np.random.default_rng().integers(1 << 40))
    corpus.write.parquet(path)
    text = search.top_k(spark.read.parquet(path), queries, 3, max_local_queries=3, block_bytes=200)._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "Union" not in text and "CoGroup" not in text and "Cartesian" not in text
    for line in text.splitlines():
        if "Exchange" in line:
            assert "vector" not in line
    below = text.split("MapInArrow", 1)[1]
    assert "Exchange" not in below.split("FileScan")[0]


def test_chunks_of_equal_names_are_told_apart(spark):
    rows = [("h1", "index#s00#0000", "one", "/a/index.html", [1.0, 0.0]), ("h2", "index#s00#0000", "two", "/b/index.html", [0.9, 0.1])]
    store = spark.createDataFrame(rows, "text_hash string, id string, content string, url string, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    found = search.search_store(store, queries, 2, 1, 0.0).collect()
    assert [(r["rank"], r["id"], r["text"], r["metadata"]["url"]) for r in found] == [(1, "index#s00#0000", "one", "/a/index.html")]
    assert sorted(r["text"] for r in search.search_store(store, queries, 2, 2, 0.0).collect()) == ["one", "two"]


def unit_ids(matrix, k):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = [np.einsum("ij,ij->i", np.repeat(q[None, :], len(unit), axis=0), unit) for q in unit]
    return {(q, i, rank) for q, row in enumerate(scores) for rank, i in enumerate(sorted(range(len(row)), key=lambda i: (-row[i], i))[:k], 1)}


@pytest.mark.parametrize("parts", [1, 12])
def test_hits_of_blocks_do_not_grow_with_the_files_of_the_corpus(spark, monkeypatch, parts):
    monkeypatch.setattr(search, "LEAST_ROWS", 1, raising=False)
    points = np.random.default_rng(3).normal(size=(48, 6))
    left = vectors(spark, points, "id", parts).select("id", F.col("embedding").alias("vector"))
    right = vectors(spark, points, "query_id", 2).select("query_id", F.col("embedding").alias("query_vector"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("raw_score", pa.float64())])
    hits = search._block_hits(left, right, 3, schema, "query_id long, id long, raw_score double", 64 << 20)
    assert hits.count() == 48 * 3


@pytest.mark.parametrize("options", [{}, {"max_local_queries": 3}, {"max_local_queries": 3, "block_bytes": 1000}])
def test_scores_that_single_precision_cannot_tell_apart(spark, options):
    noise = np.random.default_rng(4)
    near = noise.normal(size=(1, 12)) + 1e-9 * noise.normal(size=(150, 12))
    points = np.concatenate([near, near[:20], noise.normal(size=(60, 12)), 1e20 * near[:1], 1e-30 * noise.normal(size=(5, 12)), 1e30 * noise.normal(size=(5, 12))])
    got = search.top_k(vectors(spark, points, "vec_id"), vectors(spark, points, "query_id", 3), 11, **options)
    assert found(got) == unit_ids(points, 11)


def test_rows_of_one_query_id_are_one_query_with_and_without_blocks(spark):
    asked = vectors(spark, QUERIES, "query_id").withColumn("query_id", F.col("query_id") % 3)
    corpus = vectors(spark, CORPUS, "vec_id", 9)
    whole, blocks = ([(r["query_id"], r["rank"], r["raw_score"]) for r in search.top_k(corpus, asked, 8, **options).orderBy("query_id", "rank").collect()] for options in ({}, {"max_local_queries": 3}))
    assert whole == blocks and [r[1] for r in whole] == [*range(1, 9)] * 3


def test_hits_of_blocks_are_not_taken_for_a_small_table(spark):
    corpus, texts = vectors(spark, CORPUS, "vec_id"), spark.range(400).selectExpr("id AS vec_id", "cast(id AS string) AS text")
    hits = search.top_k(corpus, vectors(spark, QUERIES, "query_id"), 5, max_local_queries=3)
    for joined in (search.contexts(hits, texts), search.average_scores(spark.range(9), hits, "id")):
        assert "BuildRight" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_blocks_and_shards():
    rows, gb = search.BLOCK_ROWS, 1 << 30
    assert search._grid(3_000_000, gb, 3_000_000, 500, 20, 8, 64 << 20) == (-(-3_000_000 // rows), 1)
    assert search._grid(5_000, 1 << 20, 3_000_000, 500, 20, 8, 64 << 20) == (5, 4)
    assert search._grid(5_000, 1 << 20, 3_000_000, 2, 20, 8, 64 << 20) == (5, 2)
    assert search._grid(5_000, 1 << 20, 100 * search.SHARD_ROWS, 500, 20, 8, 64 << 20) == (5, 100)
    assert search._grid(50_000, 1 << 20, 50_000, 9, 1000, 2, 64 << 20) == (48, 1)
    assert search._grid(1, 100, 0, 0, 20, 8, 64 << 20) == (1, 1)
