"""Operator 13 against a search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from costdocs.llm import periodic_runs as runs
from tests.llm.conftest import MESSY, as_docs


def all_runs(words, limits=runs.Limits()):
    """Every stretch that repeats, for every period; the shortest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // limits.min_exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(limits.min_length, limits.min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, m, q) for (a, m), q in found.items())


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = all_runs(words)
    dropped = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def repeating(rng, size):
    words = []
    while len(words) < size:
        letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        words += [rng.choice(letters) for _ in range(rng.randint(1, 90))] * rng.choice([1, 1, 2, 3, 4, 9])
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_all_periods(seed):
    rng = random.Random(seed)
    texts = [" ".join(repeating(rng, rng.randint(0, 500))) for _ in range(12)]
    for text, (words, found) in zip(texts, runs.text_runs(list(range(12)), texts)):
        assert found.tolist() == [list(r) for r in all_runs(text.split())]
        assert words == text.encode().split()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=12), st.integers(1, 12)), max_size=8))
def test_small_alphabets(parts):
    words = [c for part, times in parts for c in part * times]
    ((_, found),) = runs.text_runs([0], [" ".join(words)])
    assert found.tolist() == [list(r) for r in all_runs(words)]


def test_other_limits():
    words = list("abcd" * 9 + "xyz" * 3)
    limits = runs.Limits(min_length=40, min_exponent=5)
    assert runs.runs_of(np.array([ord(c) for c in words]), len(words), limits).tolist() == []
    assert runs.runs_of(np.array([ord(c) for c in words]), len(words)).tolist() == [[0, 36, 4]]
    with pytest.raises(ValueError):
        runs.Limits(min_exponent=2)


def test_a_shared_fingerprint_is_found_out(monkeypatch):
    # All stretches look alike; the words still decide.
    monkeypatch.setattr(runs.Words, "prints", lambda self, size: np.zeros(len(self.ids) - size + 1, np.uint64))
    monkeypatch.setattr(runs.Words, "_same", lambda self, a, b, size: np.ones(len(a), bool))
    words = [ord(c) for c in "qwertyuiop" + "abc" * 10 + "lkjhgf"]
    assert runs.runs_of(np.array(words), len(words)).tolist() == [[10, 30, 3]]


def test_long_periods_and_long_texts():
    period = np.arange(5000) % 4999
    ids = np.concatenate([[-5], np.tile(period, 4)[:-17], [-6], np.zeros(30_000, np.int64)])
    assert runs.runs_of(ids, len(ids)).tolist() == [[1, 4 * 5000 - 17, 5000], [4 * 5000 - 15, 30_000, 1]]


def planted(count):
    rng = random.Random(9)
    return [(i, " ".join(repeating(rng, rng.randint(0, 200)) if i % 3 else map(str, rng.choices(range(5000), k=rng.randint(1, 400)))), "s") for i in range(count)]


def test_query_columns(spark):
    rows = planted(120) + [(i, t, s) for i, t, s in MESSY if i not in (7,)]
    got = runs.periodic_runs(as_docs(spark, rows), runs.with_planted_period)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_documents(no_docs):
    assert runs.periodic_runs(no_docs).collect() == [] and runs.collapsed(no_docs).collect() == []


def test_collapsed_documents_keep_their_columns(spark, messy):
    rows = [(1, "x " + "a b " * 20 + "y", "s"), (2, " two  spaces ", "s"), (3, None, None)]
    got = runs.collapsed(as_docs(spark, rows))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "x a b y", 2: " two  spaces ", 3: None}
    assert got.schema == as_docs(spark, rows).schema and runs.collapsed(messy).count() == len(MESSY)
