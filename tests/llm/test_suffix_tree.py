"""Operator 7: what it leaves on the disks, and its helpers against plain ones."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from costdocs.llm import suffix_tree
from costdocs.llm.common import LET_GO, shuffles_let_go
from tests.llm.conftest import as_docs


def shuffled(spark):
    """Bytes by file of what was shuffled and still lies on the disks."""
    found = {}
    for top in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for folder, _, names in os.walk(top.getPath()):
            for name in names:
                if name.startswith("shuffle_") and name.endswith(".data"):
                    try:
                        found[name] = os.path.getsize(f"{folder}/{name}")
                    except FileNotFoundError:  # it went meanwhile
                        pass
    return found


def test_rounds_leave_no_shuffle_on_the_disks(spark):
    rng = random.Random(3)
    docs = as_docs(spark, [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(200)), "s") for i in range(300)]).repartition(2).cache()
    docs.count()
    before = shuffled(spark)
    assert suffix_tree.suffix_tree_scores(docs).count() == 300
    for _ in range(40):
        left = sum(size for name, size in shuffled(spark).items() if name not in before)
        if left < 10_000:  # two sums of a few bytes a task
            break
        time.sleep(0.25)
    docs.unpersist()
    assert left < 10_000


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(LET_GO)
    with pytest.raises(ZeroDivisionError), shuffles_let_go(spark):
        assert spark.conf.get(LET_GO) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(LET_GO) == before


def test_small_numbers_take_few_bytes():
    """A number takes as many bytes before compression as the largest needs, with its sign."""
    values = np.random.default_rng(1).integers(-100, 100, 50_000)
    assert len(suffix_tree._squeeze(values)) < 51_000
    for values in (values, np.array([-5, 0, 2**62, -(2**63), 2**63 - 1]), np.zeros(0, np.int64), np.array([2**64 - 1, 0], np.uint64), np.array([0.5, -1e-300, 0])):
        back = suffix_tree._unsqueeze(suffix_tree._squeeze(values), values.dtype.type)
        assert back.dtype == values.dtype and back.tolist() == values.tolist()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_are_cut_at_ascii_white_space_only(monkeypatch, kind):
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 abAÄİZß", k=rng.randrange(30))) for _ in range(2000)]
    wanted = [(t or "").encode().lower().split() for t in texts]
    monkeypatch.setattr(suffix_tree, "RUN_BYTES", 100)
    column, words, counts, at = pa.array(["left out", *texts], kind).slice(1), [], [], 0
    for first, run in suffix_tree._runs(column):
        assert first == at
        some, of = suffix_tree._words(run)
        words += list(suffix_tree._spelt(some))[1:]
        counts += of.tolist()
        at += len(run)
    assert counts == [len(w) for w in wanted] and words == [w for some in wanted for w in some]


def test_chunks_of_long_words_are_bounded(spark, monkeypatch):
    docs = as_docs(spark, [(i, f"{'x' * 900}{i % 9} y", "s") for i in range(40)]).coalesce(1)
    monkeypatch.setattr(suffix_tree, "RUN_BYTES", 1000)
    whole = sorted(suffix_tree.suffix_tree_scores(docs).collect())
    monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", 5000)
    assert max(len(r.doc_ids) for r in suffix_tree.chunked(docs).collect()) < 10
    assert sorted(suffix_tree.suffix_tree_scores(docs).collect()) == whole


def test_numbers_of_narrow_and_wide_values():
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 50, 1000), rng.integers(0, 2**63 - 1, 40).repeat(3)[::-1], np.array([2**64 - 1, 0, 5, 5, 0], np.uint64), np.zeros(0, np.int64)):
        distinct, number, first = suffix_tree._numbered(values)
        wanted = np.unique(values, return_index=True, return_inverse=True)
        assert [distinct.tolist(), first.tolist(), number.tolist()] == [x.tolist() for x in wanted]
