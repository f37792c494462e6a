"""Operator 5: severity of toxic language by cumulative-link ordinal regression.

A text's features are the presence of its words and of their beginnings of four to seven letters,
so that inflected forms share what their stem has shown. P(grade >= k) = sigmoid(score - threshold k):
one weight per feature for all grades, and ordered thresholds. The output is the expected grade,
the sum of these probabilities, and whether a text is more likely graded above 0 than not.

The model is fitted on at most ``max_labelled`` labelled rows, chosen by a hash of their id.
Features are counted where the texts are; at most ``max_features`` of those that are more frequent
above grade 0, the ones with the largest log-likelihood ratio, come to the driver, with the labelled
rows as lists of them. Weights are not negative: a word can show severity, but not take it away, as
the words of a large group of harmless copies otherwise would. Every document is scored over its whole text.

Cases: a null or blank text has no features and gets the score of none. Labels without an id or a
grade are left out, the highest grade of an id counts. A grade without rows, or a table without
labels, leaves thresholds near their prior, and nothing is rejected without labels. Equal rows get
equal scores. Other columns are ignored by :func:`severity` and kept by :func:`without_toxic`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costdocs.llm.common import staged

EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
BEGINNINGS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Fit:
    grades: int = 3  # 0 … grades - 1
    max_labelled: int = 20_000
    max_features: int = 4096
    min_documents: int = 5
    min_ratio: float = 12.0  # of the log-likelihood ratio of a feature
    penalty: float = 0.005
    steps: int = 3000
    rate: float = 0.1


@dataclass(frozen=True)
class Model:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray


def word_features(word: str) -> list[str]:
    """The word without signs around it, and its beginnings; a beginning ends with a star."""
    word = EDGES.sub("", word)
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]] if word else []


class _Known(dict):
    """The number of each word's set of features in a model; most words have none, number 0."""

    def __init__(self, features: dict[str, int]):
        super().__init__()
        self.features, self.sets, self.number = features, [()], {(): 0}

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = tuple(self.features[f] for f in word_features(word) if f in self.features)
        if found not in self.number:
            self.number[found] = len(self.sets)
            self.sets.append(found)
        self[word] = self.number[found]
        return self[word]


def _present(known: _Known, text: str | None) -> list[int]:
    """The numbers of the model's features in a text, in order."""
    words = set((text or "").lower().split())
    numbers = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
    return sorted({f for n in numbers.tolist() for f in known.sets[n]})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above, zero = Counter(), Counter()
    for batch in batches:
        for text, grade in zip(batch.column("text"), batch.column("grade").to_pylist()):
            words = set((text.as_py() or "").lower().split())
            (above if grade else zero).update({f for w in words for f in word_features(w)})
    names = list(above.keys() | zero.keys())
    columns = [pa.array(names, pa.string()), pa.array([zero[n] for n in names], pa.int64()), pa.array([above[n] for n in names], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["feature", "zero", "above"])


def _likelihood_ratio(zero: Column, above: Column, n_zero: int, n_above: int) -> Column:
    """Twice the log-likelihood ratio of a feature's rate differing between the two groups."""

    def part(count: Column, rows: int) -> Column:
        share = (zero + above) / F.lit(float(max(1, n_zero + n_above)))
        inside = F.when(count > 0, count * F.log(count / (rows * share))).otherwise(0.0)
        other = F.lit(rows) - count
        return inside + F.when(other > 0, other * F.log(other / (rows * (1 - share)))).otherwise(0.0)

    return 2 * (part(zero, n_zero) + part(above, n_above))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_ordinal(
    rows: list[list[int]], grades: np.ndarray, counts: np.ndarray, n_features: int, fit: Fit
) -> tuple[np.ndarray, np.ndarray]:
    """Weights, zero or more, and ordered thresholds by gradient steps on the penalised likelihood.

    The first threshold is free, every next one is the one before plus a positive gap.
    """
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.fromiter((f for r in rows for f in r), np.int64, len(of))
    total = max(1.0, counts.sum())
    state = np.concatenate([np.zeros(n_features), [1.0], np.zeros(fit.grades - 2)])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, fit.steps + 1):
        weights, first, gaps = state[:n_features], state[n_features], np.exp(state[n_features + 1 :])
        thresholds = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(of, weights[feature], len(rows))
        reach = _sigmoid(score - thresholds[grades])  # P(grade >= g)
        beyond = _sigmoid(score - thresholds[grades + 1])  # P(grade >= g + 1)
        chance = np.maximum(reach - beyond, 1e-12)
        up, down = counts * reach * (1 - reach) / chance, counts * beyond * (1 - beyond) / chance
        by_score = (up - down) / total
        by_threshold = np.bincount(grades + 1, down, fit.grades + 1)[1:-1] / total - np.bincount(grades, up, fit.grades + 1)[1:-1] / total
        gradient = np.concatenate([
            np.bincount(feature, by_score[of], n_features) - fit.penalty / total * weights,
            [by_threshold.sum()],
            gaps * np.cumsum(by_threshold[::-1])[::-1][1:] - fit.penalty * state[n_features + 1 :] / total,
        ])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        state = state + fit.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        state[:n_features] = np.maximum(state[:n_features], 0.0)
    gaps = np.exp(state[n_features + 1 :])
    return state[:n_features], state[n_features] + np.concatenate([[0], np.cumsum(gaps)])


def train(docs: DataFrame, graded: DataFrame, fit: Fit = Fit()) -> Model:
    """A model from ``docs`` (doc_id, text) and ``graded`` (doc_id, grade)."""
    valid = graded.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, fit.grades - 1))
    best = valid.groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.max_labelled)
    chosen = staged(chosen, "labelled-ids")  # at most max_labelled rows, so it may be sent to the tasks
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    if sample.count() > fit.max_labelled:  # ids that have several rows
        by_hash = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text")
        sample = staged(by_hash.limit(fit.max_labelled), "labelled-rows")
    sample = sample.select("text", "grade")
    sizes = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    n_zero, n_above = sizes.get(0, 0), sum(n for g, n in sizes.items() if g)
    counted = sample.mapInArrow(_count, "feature string, zero long, above long").groupBy("feature").agg(F.sum("zero").alias("zero"), F.sum("above").alias("above"))
    ratio = _likelihood_ratio(F.col("zero"), F.col("above"), n_zero, n_above)
    more = F.col("above") * n_zero > F.col("zero") * n_above
    told = counted.where((F.col("zero") + F.col("above") >= fit.min_documents) & more).withColumn("ratio", ratio)
    names = [r["feature"] for r in told.where(F.col("ratio") >= fit.min_ratio).orderBy(F.desc("ratio"), "feature").limit(fit.max_features).collect()]
    features = {name: i for i, name in enumerate(sorted(names))}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Known(features), Counter()
        for batch in batches:
            for text, grade in zip(batch.column("text"), batch.column("grade").to_pylist()):
                seen[(tuple(_present(known, text.as_py())), grade)] += 1
        keys = list(seen)
        columns = [pa.array([list(k[0]) for k in keys], pa.list_(pa.int32())), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["present", "grade", "n"])

    grouped = sample.mapInArrow(vectors, "present array<int>, grade int, n long").groupBy("present", "grade").agg(F.sum("n").alias("n"))
    rows = sorted((tuple(r["present"]), r["grade"], r["n"]) for r in grouped.collect())
    present = [list(r[0]) for r in rows]
    grades, counts = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float)
    weights, thresholds = fit_ordinal(present, grades, counts, len(features), fit)
    return Model(features, weights, thresholds)


def _scorer(model: Model):
    @F.pandas_udf("severity double, risk double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Known(model.features)
        for batch in texts:
            scores = np.array([model.weights[_present(known, t)].sum() for t in batch], float)
            reach = _sigmoid(scores[:, None] - model.thresholds[None, :])
            yield pd.DataFrame({"severity": reach.sum(1), "risk": reach[:, 0]})

    return scored


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, risk, toxic) of every row: expected grade, P(grade >= 1), and whether that is over one half."""
    rows = docs.select("doc_id", _scorer(model)("text").alias("score"))
    return rows.select("doc_id", "score.severity", "score.risk", (F.col("score.risk") > 0.5).alias("toxic"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return docs.where(_scorer(model)("text")["risk"] <= 0.5)


def graded_labels(labels: DataFrame) -> DataFrame:
    """Grades from the label table: 0 not toxic, 1 toxic, 2 toxic in a text of bad quality."""
    bad = (F.coalesce("quality", F.lit(1)) == 0).cast("int")
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 1 + bad).when(F.col("toxic") == 0, 0).alias("grade"))
