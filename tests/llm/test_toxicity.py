"""Operator 5 against its definition: features, penalised likelihood and scores written down plainly."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from costdocs.llm import toxicity
from tests.llm.conftest import as_docs

FIT = toxicity.Fit(min_documents=3, min_ratio=4.0, steps=6000, rate=0.05, penalty=0.5)
MILD, GRAVE = ["nasty", "nastily", "rudeness", "rude"], ["vilest", "vileword", "hateful"]


def sample():
    rng, rows = random.Random(8), []
    for i in range(240):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(12)]
        grade = rng.choice([0, 0, 0, 1, 2])
        if grade and rng.random() < 0.9:
            words.insert(rng.randint(0, 12), rng.choice(MILD if grade == 1 else GRAVE).title() + rng.choice(["", "!", "..."]))
        elif rng.random() < 0.05:
            words.append(rng.choice(MILD))
        rows.append((i, " ".join(words), grade))
    return rows


def features_of(text):
    found = set()
    for word in text.lower().split():
        while word and not word[0].isalpha():
            word = word[1:]
        while word and not word[-1].isalpha():
            word = word[:-1]
        if word:
            found |= {word} | {word[:n] + "*" for n in (4, 5, 6, 7) if len(word) >= n}
    return found


def chosen_features(rows):
    zero, above = Counter(), Counter()
    for _, text, grade in rows:
        (above if grade else zero).update(features_of(text))
    n_zero, n_above = sum(not g for *_, g in rows), sum(g > 0 for *_, g in rows)

    def log_likelihood(hits, size, share):
        return (hits * math.log(share) if hits else 0.0) + ((size - hits) * math.log(1 - share) if size > hits else 0.0)

    chosen = set()
    for f in zero | above:
        share = (zero[f] + above[f]) / (n_zero + n_above)
        ratio = 0.0
        if share < 1:
            apart = log_likelihood(zero[f], n_zero, zero[f] / n_zero) if zero[f] else 0.0
            apart += log_likelihood(above[f], n_above, above[f] / n_above) if 0 < above[f] < n_above else 0.0
            ratio = 2 * (apart - log_likelihood(zero[f], n_zero, share) - log_likelihood(above[f], n_above, share))
        if zero[f] + above[f] >= FIT.min_documents and above[f] * n_zero > zero[f] * n_above and ratio >= FIT.min_ratio:
            chosen.add(f)
    return chosen


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def reach(weights, thresholds, text):
    score = sum(weights.get(f, 0.0) for f in features_of(text))
    return [1.0, *[sigmoid(score - t) for t in thresholds], 0.0]


def penalised(weights, thresholds, rows):
    gaps = [math.log(b - a) for a, b in zip(thresholds, thresholds[1:])]
    prior = sum(w * w for w in weights.values()) + sum(g * g for g in gaps)
    said = 0.0
    for _, text, grade in rows:
        p = reach(weights, thresholds, text)
        said += math.log(p[grade] - p[grade + 1])
    return said - FIT.penalty / 2 * prior


@pytest.fixture(scope="module")
def fitted(spark):
    docs = as_docs(spark, [(i, t, "s") for i, t, _ in sample()])
    graded = spark.createDataFrame([(i, g) for i, _, g in sample()], "doc_id long, grade int")
    return docs, toxicity.train(docs, graded, FIT)


def test_features_are_those_of_the_likelihood_ratio(fitted):
    _, model = fitted
    assert set(model.features) == chosen_features(sample())
    assert {"nasty", "nast*", "rude*", "vile*", "hateful"} <= set(model.features)


def test_no_step_raises_the_penalised_likelihood(fitted):
    _, model = fitted
    rows = sample()
    weights = {f: float(model.weights[i]) for f, i in model.features.items()}
    thresholds = model.thresholds.tolist()
    best = penalised(weights, thresholds, rows)
    for step in (0.02, -0.02):
        for f, w in weights.items():
            assert w >= 0
            if w + step >= 0:
                assert penalised({**weights, f: w + step}, thresholds, rows) <= best + 1e-3
        for i in range(len(thresholds)):
            moved = [t + step * (j >= i) for j, t in enumerate(thresholds)]
            assert penalised(weights, moved, rows) <= best + 1e-3
    assert thresholds == sorted(thresholds)


def test_severity_is_the_expected_grade(fitted):
    docs, model = fitted
    weights = {f: float(model.weights[i]) for f, i in model.features.items()}
    texts = {i: t for i, t, _ in sample()}
    got = toxicity.severity(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        p = reach(weights, model.thresholds.tolist(), texts[r["doc_id"]])
        assert r["severity"] == pytest.approx(sum(p[1:]), abs=1e-9) and r["risk"] == pytest.approx(p[1], abs=1e-9)
        assert r["toxic"] == (p[1] > 0.5)
    grades = {i: g for i, _, g in sample()}
    by_grade = [np.mean([r["severity"] for r in got if grades[r["doc_id"]] == g]) for g in (0, 1, 2)]
    assert by_grade == sorted(by_grade) and by_grade[2] > 1
