"""Operator 9 against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from costdocs.llm import simhash
from costdocs.llm.components import components
from tests.llm.conftest import MESSY, as_docs


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " ", "a", "A b C", "Ä b c d e", "a a a a a a", "x\x1cy z\x0bq\x85 r s t", "a b c d " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint_bits((text or "").encode(), window=50) == plain_fingerprint(text)


def flipped(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def signed(fps):
    return np.array(fps, np.uint64).view(np.int64)


def test_near_fingerprints_share_a_cell_and_the_bound_holds():
    rng = random.Random(2)
    a = [rng.getrandbits(64) for _ in range(1500)]
    b = [flipped(rng, x, rng.randint(0, 9)) for x in a]
    bits = np.array([(x ^ y).bit_count() for x, y in zip(a, b)])
    assert (simhash._linked(signed(a), signed(b), 4) == (bits <= 4)).all()
    row, cell = simhash.grid_cells(signed(a + b))
    cells = [set() for _ in range(3000)]
    for r, c in zip(row.tolist(), cell.tolist()):
        cells[r].add(c)
    assert all(cells[i] & cells[i + 1500] for i in range(1500) if bits[i] <= 4)


def roots_by_pairs(fps, max_bits):
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits and root[a] > root[b]:
                    root[a], changed = root[b], True
    return root


@pytest.mark.parametrize("limits, max_bits", [((512, 4096, 32), 4), ((0, 5, 2), 4), ((2, 20, 1), 2)])
def test_components_of_near_fingerprints(spark, monkeypatch, limits, max_bits):
    for name, value in zip(("HOME_LIMIT", "BLOCK", "SMALL_RUN"), limits):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(max_bits)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {flipped(rng, s, rng.randint(0, 5)) for s in seeds for _ in range(12)} | {rng.getrandbits(64) for _ in range(20)} | {0, 1, 2**64 - 1}
    fps = signed(sorted(fps)).tolist()
    pairs = simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), max_bits)
    found = {r.node: r.root for r in components(pairs).collect()}
    wanted = roots_by_pairs(fps, max_bits)
    assert {f: found.get(f, f) for f in fps} == wanted


def test_too_many_bits(spark):
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.createDataFrame([(1,)], "fp long"), 5)


def test_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (400, 399)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(200)}, 400: 399, 399: 399}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_documents(spark, messy):
    rows = simhash.simhash_components(messy).collect()
    fps = {f: [i for i, t, _ in MESSY if plain_fingerprint(t) == f] for f in {plain_fingerprint(t) for _, t, _ in MESSY}}
    root = roots_by_pairs(list(fps), 4)
    groups = {}
    for f, ids in fps.items():
        groups.setdefault(root[f], []).extend(i for i in ids if i is not None)
    wanted = sorted((str(i), f"{plain_fingerprint(t):016x}", str(min(groups[root[plain_fingerprint(t)]], default=None))) for i, t, _ in MESSY)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == wanted


def test_one_row_of_each_group_stays(spark, messy, no_docs):
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted(
        (str(i), t) for i, t in {(1, None), (4, MESSY[5][1]), (5, MESSY[6][1]), (7, MESSY[9][1]), (8, MESSY[10][1]), (-9, "one"), (None, "a b c d e f")}
    )
    assert simhash.keep_one(no_docs).collect() == [] == simhash.simhash_components(no_docs).collect()


def test_same_id_with_two_texts(spark):
    docs = as_docs(spark, [(1, "a b c d e f g", "s"), (1, "q w e r t y u i", "s"), (2, "a b c d e f g", "s")])
    assert sorted(r.text for r in simhash.keep_one(docs).collect()) == ["a b c d e f g", "q w e r t y u i"]
