"""Operator 6 by its invariants and a plain computation of the targets."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from costdocs.llm import mixing
from tests.llm.conftest import MESSY, as_docs


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, todo = share * sum(sizes.values()), {}, set(names)
    while todo:
        unit = left / sum(weight[s] for s in todo)
        over = {s for s in todo if unit * weight[s] > repeats * sizes[s]}
        for s in over or todo:
            target[s] = repeats * sizes[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        todo -= over or todo
    return target


def words(text):
    return len(re.findall("[^\\x20\\x09-\\x0d]+", text or ""))


def corpus(spark):
    rows = [(i, "w " * (i % 37), ("hot", "b", "c", None)[0 if i % 3 else i % 4]) for i in range(900)]
    return rows, as_docs(spark, rows).repartition(5)


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(block_words=200, shard_words=800), mixing.Mix(weights=(1.0, 50.0), share=1.9, block_words=100, shard_words=100)])
def test_targets_are_met(spark, mix):
    rows, docs = corpus(spark)
    found = mixing.mixed_words(docs, mix).collect()
    size = {i: words(t) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sums = Counter()
    for i, s in source.items():
        sums[s] += size[i]
    target, taken = plain_targets(sums, mix.weights, mix.share), Counter()
    assert len(found) == len(rows)
    for r in found:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sums[s]) and r.target == pytest.approx(target[s])
        assert r.taken == r.size * len(r.draws) <= 2 * r.size and len({d.turn for d in r.draws}) == len(r.draws)
        taken[s] += r.taken
    for s in sums:
        assert abs(taken[s] - target[s]) <= max(size.values())
    again = {r.doc_id: r.draws for r in mixing.mixed_words(docs.repartition(3), mix).collect()}
    assert again == {r.doc_id: r.draws for r in found}


def test_blocks_are_dealt_evenly_and_once(spark):
    root = spark.createDataFrame([(1, [1000, 0, 37, 5])], "node long, counts array<long>")
    rows = mixing.splitting_tree(root, 4, 3).collect()
    assert len(rows) == 64
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        assert r.n >= 0
        by_source[r.source_no] += r.n
        by_shard[r.shard] += r.n
    assert [by_source[i] for i in range(4)] == [1000, 0, 37, 5]
    assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_draws_follow_the_distribution(spark):
    roots = spark.range(1, 4001).select(F.col("id").alias("node"), F.expr("array(6L, 4L, 10L)").alias("counts"))
    halves = mixing.splitting_tree(roots, 1, 1).where("source_no = 0 and pmod(shard, 2) = 0").groupBy("n").count().collect()
    from math import comb

    for r in halves:
        chance = comb(6, r.n) * comb(14, 10 - r.n) / comb(20, 10)
        assert abs(r["count"] / 4000 - chance) < 0.03
    assert sum(r["count"] for r in halves) == 4000


def test_mixture_has_the_drawn_rows(spark):
    rows, docs = corpus(spark)
    mix = mixing.Mix(block_words=200, shard_words=800)
    drawn = Counter({r.doc_id: len(r.draws) for r in mixing.mixed_words(docs, mix).collect() if r.draws})
    mixed = mixing.mixture(docs, mix)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == drawn


def test_no_python_runs(spark):
    _, docs = corpus(spark)
    for df in (mixing.mixed_words(docs), mixing.mixture(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_messy_documents(spark, messy, no_docs):
    found = mixing.mixed_words(messy).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(i), words(t)) for i, t, _ in MESSY)
    assert mixing.mixture(messy).columns == messy.columns
    assert mixing.mixed_words(no_docs).collect() == [] == mixing.mixture(no_docs).collect()
    blank = mixing.mixed_words(as_docs(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
