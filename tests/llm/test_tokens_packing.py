"""Operators 1 and 3 against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from costdocs.llm import packing, planes, tokens
from costdocs.sources.scratch import scratch_path
from tests.llm.conftest import MESSY, as_docs

WORDS = ["the", "it's", "don't", "äö", "İ", "Σ", " ", "  ", "\n", " \n", "\t", ".", "...", "'", "12", "中", "\x1c", "\x85", "é", "ẖ", "<|endoftext|>", "<|startoftext|>", "<|endof", "</w>", "A"]


def encoder_of(name):
    made = tokens.Encoder(tokens.vocabulary(name))
    made.fresh = Tokenizer.from_file(tokens.vocabulary(name))  # as the library gives it
    return made


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def encoder(request):
    return encoder_of(request.param)


def direct(encoder, text):
    return encoder.fresh.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("window", [tokens.WINDOW, 12])
def test_pieces_give_the_ids_of_the_text(encoder, monkeypatch, window):
    monkeypatch.setattr(tokens, "WINDOW", window)
    rng = random.Random(5)
    texts = [None, "", " ", "a ", *("".join(rng.choices(WORDS, k=rng.randint(1, 16))) for _ in range(4000))]
    lengths, ids = encoder.encode(texts)
    ends = np.cumsum(lengths)
    for text, begin, end in zip(texts, ends - lengths, ends):
        assert ids[begin:end].tolist() == direct(encoder, text), repr(text)


def test_memo_that_overflows(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 3)
    for text in ("a b c d", "e f g", "a z"):
        assert encoder.encode([text])[1].tolist() == direct(encoder, text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_planes_round_trip(unit):
    rng = np.random.default_rng(1)
    for top, count in ((1, 1), (2, 17), (300, 1000), (2**32 - 1, 65)):
        ids = rng.integers(0, top, count, dtype=np.uint32)
        assert (planes.join_planes(planes.split_planes(ids, unit), count, unit) == ids).all()


def read_all(spark, docs, form, shard_ids=planes.SHARD_IDS):
    path = scratch_path(spark, "test-planes")
    manifest = planes.write_planes(docs, path, tokens.vocabulary("word_bpe_49k.json"), 2, form, shard_ids)
    return path, manifest, planes.read_planes(spark, path, manifest).collect()


@pytest.mark.parametrize("form, shard", [(planes.Format(), 1 << 24), (planes.Format(64, "byte"), 500), (planes.Format(7, "bit"), 1)])
def test_files_hold_all_ids_in_order(spark, messy, form, shard):
    path, manifest, rows = read_all(spark, messy, form, shard)
    encoder = encoder_of("word_bpe_49k.json")
    wanted = sorted(((-(10**9) if i is None else i, len(e) + 1, crc([*e, 2])) for i, t, _ in MESSY for e in [direct(encoder, t)]))
    assert sorted((-(10**9) if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == wanted
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    first = manifest.orderBy("part", "seq").first()
    with pyarrow.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")[0].open_input_file(f"{path.split('://')[-1]}/{first.file}") as file:
        index = planes.read_index(file)
        last = len(index["blocks"]) - 1
        assert len(planes.read_block(file, index, last)) == index["blocks"][last][1] <= form.block_ids


def test_a_worker_gets_a_few_texts_at_a_time(spark, monkeypatch):
    texts, batch_size = planes.text_batches, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def watched(batch, column):
        assert batch.nbytes < 8 << 20, f"{batch.nbytes} bytes of texts at a time"
        return texts(batch, column)

    monkeypatch.setattr(planes, "text_batches", watched)
    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('ab ', 200000 + int(id)) AS text").coalesce(1)
    rows = read_all(spark, docs, planes.Format())[2]
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(i, 200_001 + i) for i in range(60)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == batch_size


def test_no_documents(spark, no_docs):
    assert planes.plane_digest(spark, no_docs).collect() == []
    assert packing.pack_documents(no_docs).collect() == []


def best_fit_by_one(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - b >= n]
        if fits:
            bins[bins.index(max(fits))] += n
        else:
            bins.append(n)
    return len(bins)


def fewest(lengths, capacity):
    """The least number of bins, by trying everything."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + lengths[i] <= capacity:
                left = list(bins)
                left[left.index(b)] += lengths[i]
                place(i + 1, left)
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def held(bins, capacity):
    counts = np.zeros(capacity + 1, np.int64)
    for group in bins:
        assert sum(group.lengths) <= capacity
        np.add.at(counts, list(group.lengths), group.count)
    return counts


@pytest.mark.parametrize("seed", range(40))
def test_fixed_bins_never_cost_a_bin(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 24))
    lengths = rng.integers(rng.integers(1, 4), capacity + 1, 9)
    counts = np.bincount(lengths, minlength=capacity + 1)
    fixed, rest = packing.reduce_instance(counts, capacity)
    assert (held(fixed, capacity) + rest == counts).all()
    remaining = np.repeat(np.arange(capacity + 1), rest).tolist()
    assert sum(b.count for b in fixed) + fewest(remaining, capacity) == fewest(lengths.tolist(), capacity)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_by_groups_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, 400)
    counts = np.bincount(lengths, minlength=65)
    bins = packing.best_fit(counts, 64)
    assert (held(bins, 64) == counts).all()
    assert sum(b.count for b in bins) == best_fit_by_one(lengths.tolist(), 64)


@pytest.mark.parametrize("capacity", [2048, 50])
def test_sequences_have_no_gaps(spark, messy, capacity):
    rows = packing.pack_documents(messy, capacity).collect()
    encoder = encoder_of("byte_bpe_50k.json")
    pieces = defaultdict(list)
    for i, text, _ in MESSY:
        ids = [*direct(encoder, text), 0]
        short = len(ids) % capacity or capacity
        cuts = [0, *range(short, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[i].append((p, a, b - a, crc(ids[a:b])))
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in pieces.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_equal_lengths_are_split_over_tasks(spark):
    docs = as_docs(spark, [(i, "word " * (i % 3), "s") for i in range(600)]).repartition(7)
    rows = packing.pack_documents(docs, 8).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 600
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 8) + 1
