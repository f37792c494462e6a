"""The pipeline on messy tables; severity against its plain definition."""

import math

import numpy as np
import pytest

import corpus_pipeline
from costdocs.llm import simhash, toxicity
from tests.llm.conftest import MESSY, as_docs

PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def words(i, n=60):
    rng = np.random.default_rng(i)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))


def written(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long, size string").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus(spark):
    clean = [(100 + i, words(i), f"s{i % 3}") for i in range(60)]
    toxic = [(200 + i, words(1000 + i) + " vileword vileword", "s1") for i in range(12)]
    copies = [(300 + i, clean[i][1], "s2") for i in range(5)] + [clean[7]]
    return as_docs(spark, clean + toxic + copies + [r for r in MESSY if r[0] != 7])


LABELS = [(100 + i, 1, 0, "x") for i in range(40)] + [(200 + i, 0, 1, "x") for i in range(8)] + [(100, 1, 0, "x"), (None, 1, 1, "x"), (101, None, None, "x"), (999, 0, 1, "x")]


@pytest.mark.parametrize("labels", [LABELS, []], ids=["labels", "no labels"])
def test_messy_documents_go_through(spark, tmp_path, corpus, labels):
    got = corpus_pipeline.run(spark, written(spark, tmp_path, corpus, labels))
    assert set(PIECE) <= set(got.columns)
    rows = got.select(PIECE).collect()
    ids = {r["doc_id"] for r in rows}
    kept = set(range(100, 160))
    assert ids & set(range(300, 305)) == set()  # copies of smaller ids
    if labels:
        assert ids & set(range(200, 212)) == set()
    assert len(ids & kept) >= 55  # the mixture may leave some out at its border
    for s in {r["sequence_id"] for r in rows}:
        places = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in places] == list(np.cumsum([0] + [n for _, n in places])[:-1]) and sum(n for _, n in places) <= 2048


def test_no_documents(spark, tmp_path):
    got = corpus_pipeline.run(spark, written(spark, tmp_path, as_docs(spark, []), LABELS))
    assert got.collect() == [] and set(PIECE) <= set(got.columns)


def test_of_equal_rows_one_stays(spark):
    from pyspark.sql import functions as F

    rows = as_docs(spark, [(1, words(1), "b"), (1, words(1), "a"), (1, words(1), "a"), (2, words(1), "a"), (3, words(2), None), (None, words(3), "a"), (None, words(3), "a")])
    got = simhash.keep_one(rows.withColumn("extra", F.col("source")))
    assert sorted((str(r["doc_id"]), r["source"]) for r in got.collect()) == [("1", "a"), ("3", None), ("None", "a")]
    assert got.columns == [*rows.columns, "extra"]


def test_texts_that_are_null_are_not_toxic(spark, corpus):
    model = toxicity.train(corpus, toxicity.graded_labels(spark.createDataFrame(LABELS, "doc_id long, quality long, toxic long, size string")))
    kept = {r["doc_id"] for r in toxicity.without_toxic(corpus, model).collect()}
    assert {1, 2, 3} <= kept and not kept & set(range(200, 212)) and math.isfinite(len(kept))
