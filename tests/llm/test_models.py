"""Operators 5 and 7 against plain computations, and the pipeline's stages."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from costdocs.llm import suffix_tree, toxicity
from costdocs.llm.common import staged
from tests.llm.conftest import CLASHING, MESSY, as_docs


def plain_scores(docs, growth):
    texts = [(i, [*(t or "").encode().lower().split(), b""], suffix_tree.held_out(i)) for i, t, _ in docs]
    count = Counter(w for _, words, held in texts if not held for w in words)
    total, known = sum(count.values()), len(count)
    floors = max(2.0, growth.min_context * total), max(2.0, growth.min_pair * total)
    frequent, retained = {w for w in count if count[w] >= floors[1]}, {}
    contexts = [{(w,): n for w, n in count.items() if n >= floors[0] and w and w in frequent}]

    def chance(s, x):
        if not s:
            return (count[x] + 1) / (total + known + 1)
        if s not in retained:
            return chance(s[1:], x)
        n, kept = retained[s]
        return (kept.get(x, 0) + (n - sum(kept.values()) + growth.mass) * chance(s[1:], x)) / (n + growth.mass)

    for length in range(1, growth.depth + 1):
        after = defaultdict(Counter)
        for _, words, held in texts:
            for i in range(length, len(words)):
                if not held and tuple(words[i - length : i]) in contexts[-1] and words[i] in frequent:
                    after[tuple(words[i - length : i])][words[i]] += 1
        longer, new = {}, {}
        for s, n in contexts[-1].items():
            kept = {x: c for x, c in after[s].items() if c >= floors[1]}
            rest = max(0.0, 1 - sum(kept.values()) / n)
            gain = sum(c / n * math.log(c / n / chance(s[1:], x)) for x, c in kept.items())
            gain += rest * math.log(max(rest, 1e-300) / max(1e-300, 1 - sum(chance(s[1:], x) for x in kept)))
            if gain >= growth.divergence:
                new[s] = n, kept
            longer |= {(*s, x): c for x, c in kept.items() if c >= floors[0] and x}
        retained |= new
        contexts.append(longer)
    out = []
    for i, words, held in texts:
        score = 0.0
        for at, word in enumerate(words):
            s = ()
            for length in range(1, min(at, growth.depth) + 1):
                if tuple(words[at - length : at]) not in contexts[length - 1]:
                    break
                s = tuple(words[at - length : at])
            score += math.log10(chance(s, word))
        out.append((str(i), held, len(words), sum(count[w] > 0 for w in words), total, sum(math.log10(chance((), w)) for w in words), score))
    return sorted(out), len(retained)


def phrases(seed, count):
    rng = random.Random(seed)
    said = ["the cat sat", "on the mat", "a dog sat", "Over the hill", "w%d"]
    return [(i, " ".join(p % rng.randrange(50) if "%" in p else p for p in rng.choices(said, k=rng.randint(0, 40))), "s") for i in range(count)]


@pytest.mark.parametrize("chunk", [50, 1 << 22])
@pytest.mark.parametrize("rows", [phrases(1, 150) + MESSY, MESSY])
def test_suffix_tree_scores(spark, monkeypatch, rows, chunk):
    monkeypatch.setattr(suffix_tree, "WINDOW_TOKENS", 64)
    growth = suffix_tree.Growth(min_context=0.002, min_pair=0.001, divergence=0.05, mass=2.0)
    wanted, retained = plain_scores(rows, growth)
    assert retained > 3 or rows is MESSY
    found = sorted((str(r.doc_id), *r[1:]) for r in suffix_tree.suffix_tree_scores(as_docs(spark, rows).repartition(3), growth, chunk).collect())
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in wanted], rtol=1e-9)


def test_a_held_out_text_is_more_likely_with_its_context(spark):
    rows = suffix_tree.suffix_tree_scores(as_docs(spark, phrases(2, 300)), suffix_tree.Growth(mass=5.0)).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.8


def test_what_is_learnt_grows_with_the_corpus(spark, monkeypatch):
    """A passage of a few texts raises their scores however large the rest of the corpus is."""
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 1 << 14)
    rng = random.Random(9)
    passage = " ".join(f"rare{i}" for i in range(60))
    other = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(400)), "s") for i in range(10, 410)]
    said = [i for i in range(10) if not suffix_tree.held_out(i)][:4]
    held = next(i for i in range(1000, 1100) if suffix_tree.held_out(i))
    docs = [(i, passage, "s") for i in (*said, held)] + other
    found = {r.doc_id: r for r in suffix_tree.suffix_tree_scores(as_docs(spark, docs), suffix_tree.Growth(mass=1.0), 1 << 14).collect()}
    assert found[held].score > found[held].base_score / 2
    wanted, retained = plain_scores(docs, suffix_tree.Growth(mass=1.0))
    assert retained > 100
    assert np.allclose(sorted(r.score for r in found.values()), sorted(r[-1] for r in wanted), rtol=1e-9)


def test_nothing_to_learn_from(spark, no_docs):
    assert suffix_tree.suffix_tree_scores(no_docs).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = suffix_tree.suffix_tree_scores(as_docs(spark, [(held, "a b", "s")])).collect()
    assert [tuple(r) for r in row] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def labelled(spark, count=900):
    """Harsh stems with endings, and harmless prose; grade 2 has a stem of its own."""
    rng = random.Random(4)
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, grades = [], []
    for i in range(count):
        words = rng.choices(plain, k=rng.randint(5, 60))
        grade = (0, 0, 0, 1, 2)[i % 5]
        for _ in range(grade and rng.randint(1, 3)):
            words.insert(rng.randrange(len(words)), ("", "Zorgl", "kwistu")[grade] + "".join(rng.choices("uvw", k=rng.randint(1, 4))) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), "s"))
        grades.append((i, grade))
    return as_docs(spark, rows), grades


def test_grades_of_unseen_documents(spark):
    docs, grades = labelled(spark)
    graded = spark.createDataFrame([g for g in grades if g[0] < 500] + [(0, None), (None, 2)], "doc_id long, grade int")
    model = toxicity.train(docs, graded)
    assert list(model.thresholds) == sorted(model.thresholds) and (model.weights >= 0).all()
    found = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    new = [(found[i], g) for i, g in grades if i >= 500]
    assert sum(r.toxic == (g > 0) for r, g in new) / len(new) > 0.97
    assert not any(r.toxic for r, g in new if g == 0)
    means = [np.mean([r.severity for r, g in new if g == k]) for k in range(3)]
    assert means[0] < 0.2 < 0.8 < means[1] < means[2] - 0.2
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in found if not found[i].toxic)


def test_rows_of_one_labelled_id_are_bounded(spark, monkeypatch):
    docs = as_docs(spark, [(1, f"word{i} other", "s") for i in range(300)] + [(2, "calm words", "s")])
    fitted, fit_ordinal = [], toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda rows, grades, counts, *a: fitted.append(counts.sum()) or fit_ordinal(rows, grades, counts, *a))
    graded = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, grade int")
    for most, rows in ((40, 40), (301, 301)):
        toxicity.train(docs, graded, toxicity.Fit(max_labelled=most, steps=5))
        assert fitted.pop() == rows


def test_gradient_reaches_the_likeliest_thresholds():
    fit = toxicity.Fit(steps=4000, penalty=1e-9)
    weights, thresholds = toxicity.fit_ordinal([[], [], []], np.array([0, 1, 2]), np.array([50.0, 30.0, 20.0]), 0, fit)
    assert len(weights) == 0
    assert [1 / (1 + math.exp(t)) for t in thresholds] == pytest.approx([0.5, 0.2], abs=0.01)


def test_messy_texts_and_labels(spark, messy, no_docs):
    none = spark.createDataFrame([], "doc_id long, grade int")
    for docs in (messy, no_docs):
        rows = toxicity.severity(docs, toxicity.train(docs, none)).collect()
        assert len(rows) == docs.count() and not any(r.toxic for r in rows)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, 1), (3, 0, 1), (4, 1, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert [(r.doc_id, r.grade) for r in toxicity.graded_labels(labels).collect()] == [(1, 1), (1, 0), (2, 1), (3, 2), (4, None), (5, 0)]


def test_stages(spark, sf_dir):
    """Every stage on what the one before kept, with its columns; the last one's pieces have no gaps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(1) for c in CLASHING})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert ids and set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(ids)
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *[n for _, n in sorted(places)]])[:-1].tolist()
