"""Operator 12 against a trie of tuples."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from costdocs.llm import prefix_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    clashing = "key1 string, shard int, size long, content string"
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], f"conv_id long, turn long, role string, text string, {clashing}")


def plain(rows):
    own, rebuilt, nodes = {}, {}, {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
        for d in range(len(rebuilt[c]) + 1):
            nodes.setdefault(rebuilt[c][:d], []).append(c)
    children = {}
    for s in nodes:
        if s:
            children.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        below = children.get(s, [])
        leaves[s] = sum(leaves[k] for k in below) if below else 1
        saved[s] = sum(saved[k] for k in below) + ((len(nodes[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    out = []
    for s, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(s))))
        out.append((min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(children.get(s, [])), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


def sample(seed):
    rng, rows = random.Random(seed), []
    for c in [*rng.sample(range(-7, 40), 30), None]:
        for t in range(rng.choice([0, 1, 2, 3, 9, 20, 30])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "é"])))
    return rows


@pytest.mark.parametrize("seed, shards", [(0, trie.Shards()), (1, trie.Shards(piece=4, rows=50)), (2, trie.Shards(piece=1, rows=7))])
def test_trie_of_messy_conversations(spark, monkeypatch, seed, shards):
    monkeypatch.setattr(trie, "HEAVY", 2)
    assert found(trie.conversation_trie(table(spark, sample(seed)), shards)) == plain(sample(seed))


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(5, t, "user", "x" * (t % 3)) for t in range(400)] + [(c, 0, "user", "hello") for c in range(1000, 1300)]
    assert found(trie.conversation_trie(table(spark, rows), trie.Shards(piece=32, rows=100))) == plain(rows)


def test_no_conversations(spark):
    assert trie.conversation_trie(table(spark, [])).collect() == []
    assert trie.conversation_trie(table(spark, [(None, 1, "user", "x")])).collect() == []


@pytest.mark.parametrize("count", [0, 1, 2, 1000, 50_000])
def test_every_key_has_a_slot_of_its_own(count):
    rng = np.random.default_rng(count)
    a, b = rng.integers(0, 1 << 63, (2, count), dtype=np.uint64)
    table = trie.PerfectHash(a, b)
    assert len(table) == count and sorted(table.slots(a, b).tolist()) == list(range(count))
    assert (table.slots(b, a + np.uint64(1)) == -1).all()


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        trie.PerfectHash(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_two_prefixes_with_one_digest_are_found_out():
    same = np.array([0, 7, 0, 7], np.uint64)
    with pytest.raises(ValueError, match="one digest"):
        trie.node_table(0, np.array([1, 1, 2, 2]), np.array([0, 1, 0, 1]), same, same, np.array([0, 5, 0, 6]), np.array([1, 1, 1, 1]), np.array([True, False, True, False]), 4096)


def test_ids_of_a_node_are_hashed_as_a_stream(spark):
    ids = [(1, 2, i) for i in range(5000)] + [(1, 3, 7), (-4, 0, 9), (-4, 0, -1)]
    got = {(r["key1"], r["key2"]): r["ends_sha256"] for r in trie.end_hashes(spark.createDataFrame(ids, "key1 long, key2 long, conv_id long").repartition(5)).collect()}
    wanted = {(1, 2): ",".join(map(str, range(5000))), (1, 3): "7", (-4, 0): "-1,9"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in wanted.items()}
