"""Operator 7: a probabilistic suffix tree over words, learnt from part of the corpus, scores all texts.

Texts become chunks of word numbers with a dictionary each, a table that is written once and never
moved. Counts are made in rounds. Every chunk sends the hashes of what it holds (words, then contexts
with a next symbol) in order, as differences, with its own counts, to buckets of the range of
hashes; a bucket adds up and answers each chunk in the same order. Only answers are written, in a
folder per part of the chunk table, and a chunk's task reads its own; what a round shuffled leaves the
disks as soon as its answers are written. So words move once per chunk
and not once per occurrence, and nothing that grows with the vocabulary is sent whole to a task.

Contexts grow word by word. A context is a candidate if it occurs ``least`` times in the training
texts, and a next symbol is kept if it does so together with its context; the counts do not depend on
the size of the corpus, so the tree grows with it. (``min_context`` and ``min_pair`` raise them to
shares of all training tokens.) A candidate is retained if the divergence of its next-symbol
distribution from that of its longest retained suffix is at least ``divergence`` nats. The tree is
never in one place: every chunk asks for the contexts and symbols that it holds, a level at a time.
Contexts are up to ``depth`` words long; a further one costs a round, and a replay in each. The probability of a symbol is

    P(x | s) = (n(s, x) + (n(s) - kept(s) + mass) * P(x | suffix of s)) / (n(s) + mass)

with n(s, x) = 0 for symbols that are not kept and P(x) = (c + 1) / (N + V + 1) at the root, so
every distribution adds up to one. Words are told apart by a 64-bit hash of their bytes, and
contexts by a hash of those with 22 more bits than the number of tokens has, so that about one in four
million meets another's.

Cases: a null text is an empty one, which is its end token only. A null id trains (the check sum
of its empty text). Repeated rows are scored, and learnt, one by one. Without training documents
every score is that of the root, log10 of one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costdocs.llm.common import open_store, shuffles_let_go, staged
from costdocs.sources.scratch import scratch_path

CHUNK_TOKENS = 1 << 19
CHUNK_BYTES = 1 << 26  # of words, which a chunk has as they are until it is full
WINDOW_TOKENS = 1 << 16  # rows that are sent at once
RUN_BYTES = 1 << 20  # texts that are split into words at once
FOLDS, HELD_OUT = 7, 2


@dataclass(frozen=True)
class Growth:
    depth: int = 3
    least: float = 2.0
    min_context: float = 0.0
    min_pair: float = 0.0
    divergence: float = 0.02
    mass: float = 50.0

    def floors(self, train: int) -> tuple[float, float]:
        """The least counts of a context and of a symbol with its context."""
        return max(self.least, self.min_context * train), max(self.least, self.min_pair * train)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers of eight bytes by as many byte planes as the largest needs, compressed; first comes the number of planes."""
    import zstandard

    whole = values.view(np.uint64)
    if values.dtype == np.int64:  # the sign goes last
        whole = (values << 1 ^ values >> 63).view(np.uint64)
    planes = max(1, -(-int(whole.max(initial=0)).bit_length() // 8))
    raw = b"".join((whole >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(planes))
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unsqueeze(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    whole = np.zeros(planes.shape[1], np.uint64)
    for i, plane in enumerate(planes):
        whole |= plane.astype(np.uint64) << np.uint64(8 * i)
    if kind is np.int64:
        return (whole >> np.uint64(1)).view(np.int64) ^ -(whole & np.uint64(1)).view(np.int64)
    return whole.view(kind)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, one text after the other, and how many each has)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    pieces = split.flatten()
    some = pc.not_equal(pieces, "")  # white space at either end leaves an empty piece
    return pieces.filter(some), np.bincount(pc.list_parent_indices(split).filter(some).to_numpy(), minlength=len(texts))


def _spelt(words: pa.Array) -> Iterator[bytes]:
    """The end of a text, and the words; cut from their buffer, which is faster than Arrow's values one by one."""
    words = words.cast(pa.large_binary())
    _, ends, raw = words.buffers()
    cuts, data = np.frombuffer(ends, np.int64, len(words) + 1, 8 * words.offset).tolist(), raw.to_pybytes() if raw else b""
    return chain([b""], (data[a:b] for a, b in pairwise(cuts)))


def _runs(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of about ``RUN_BYTES``: (index of the first, texts)."""
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // RUN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    for first, end in pairwise(cuts):
        if first < end:
            yield first, texts.slice(first, end - first)


_CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, codes binary, words binary, counts binary, train long"


def chunked(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of whole documents: word numbers, the chunk's words (hashes) and their training counts.

    Number 0 is the end of a text.
    """

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def row() -> pa.RecordBatch:
            coded = pa.concat_arrays(parts).dictionary_encode()
            flat = np.zeros(sum(lengths), np.int64)
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(lengths) - 1] = False
            flat[inner] = coded.indices.to_numpy() + 1
            train = np.repeat(~np.array(held, bool), lengths)
            words = np.array([xxhash.xxh64_intdigest(w) for w in _spelt(coded.dictionary)], np.uint64)
            counts = _squeeze(np.bincount(flat[train], minlength=len(words)))
            number = (part << 32) + made
            values = [number, ids, held, lengths, _squeeze(flat.view(np.uint64)), words.tobytes(), counts, int(train.sum())]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        part, made = TaskContext.get().partitionId(), 0
        names = [c.split()[0] for c in _CHUNK.split(", ")]
        ids, held, lengths, parts, size = [], [], [], [], 0
        for batch in batches:
            of = batch.column("doc_id").to_pylist()
            for first, texts in _runs(batch.column("text")):
                words, counts = _words(texts)
                begin = end = 0
                for i, count in enumerate(counts.tolist(), first):
                    ids.append(of[i])
                    held.append(held_out(of[i]))
                    lengths.append(count + 1)
                    size += count + 1
                    end += count
                    if size >= chunk_tokens or i + 1 == first + len(texts):
                        parts.append(words.slice(begin, end - begin))
                        begin = end
                        if size >= chunk_tokens or sum(p.nbytes for p in parts) >= CHUNK_BYTES:
                            yield row()
                            made += 1
                            ids, held, lengths, parts, size = [], [], [], [], 0
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(chunk, _CHUNK)


@dataclass
class Grams:
    """A chunk's contexts of one length and what follows them, numbered in the chunk."""

    context_keys: np.ndarray  # by context: its hash
    totals: np.ndarray  # by context: how often it occurs in the training texts of the corpus
    before: np.ndarray  # by position: the context before it, or -1
    at: np.ndarray  # positions that have a context and a symbol
    entry: np.ndarray  # their entries
    context: np.ndarray  # by entry: its context
    symbol: np.ndarray  # by entry: its word number
    keys: np.ndarray  # by entry: the hash of context and symbol


def _after(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Every position's value from the position before, -1 at the beginning of a text."""
    moved = np.empty_like(values)
    moved[1:] = values[:-1]
    moved[begins] = -1
    return moved


def _mixed(keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = keys.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, ascending, the number of each value, the place at which each distinct one is first)."""
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, bits = values.min(), np.uint64(len(values).bit_length())
    if (int(values.max()) - int(low)).bit_length() + int(bits) <= 64:  # numbers are sorted faster than places by numbers
        packed = np.sort((values - low).astype(np.uint64) << bits | np.arange(len(values), dtype=np.uint64))
        order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        packed >>= bits
    else:
        order = np.argsort(values, kind="stable")
        packed = values[order]
    new = np.empty(len(values), bool)
    new[0] = True
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return values[first], number, first


class _Chunk:
    """A chunk and what it was told, round by round: counts of its words, then of its contexts' entries, and sums."""

    def __init__(self, row: dict, told: list[dict], learnt: Learnt, growth: Growth):
        self.row, self.told, self.learnt, self.growth = row, told, learnt, growth
        self.floors = growth.floors(learnt.train)
        self.words = np.frombuffer(row["words"], "<i8").view(np.uint64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.codes = _unsqueeze(row["codes"], np.uint64).view(np.int64)
        if told:
            self.c = np.zeros(len(self.words), np.int64)
            self.c[np.argsort(self.words)] = np.abs(told[0]["n"])
            self.root = (self.c + 1.0) / (learnt.train + learnt.vocabulary + 1.0)
            self.chance = self.root[self.codes]
            self.known = self.c >= self.floors[1]

    def order(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, short keys in order) in which keys are sent and answered: by their high bits, then as they are numbered."""
        low = np.uint64((1 << len(keys).bit_length()) - 1)
        order = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
        return order, keys[order] >> np.uint64(64 - self.learnt.bits)

    def first(self) -> Grams:
        number = np.where(self.known & (self.c >= self.floors[0]), np.arange(len(self.c)), -1)
        number[0] = -1  # the end of a text is before no symbol
        return self._grams(_mixed(self.words), self.c, number[self.codes], self.known[self.codes])

    def next(self, grams: Grams, n: np.ndarray) -> Grams:
        """The contexts one longer, after the counts of the entries are known.

        A symbol that is not kept after a context is not frequent enough after any longer one, so it is not asked for.
        """
        number = np.where((n >= self.floors[0]) & (grams.symbol != 0), np.arange(len(n)), -1)
        here = np.full(len(self.codes), -1)
        here[grams.at] = number[grams.entry]
        kept = np.zeros(len(self.codes), bool)
        kept[grams.at] = n[grams.entry] > 0
        return self._grams(grams.keys, n, here, kept)

    def _grams(self, keys: np.ndarray, totals: np.ndarray, here: np.ndarray, kept: np.ndarray) -> Grams:
        before = _after(here, self.begins)
        at = np.flatnonzero((before >= 0) & kept)
        context, symbol = before[at], self.codes[at]
        _, entry, first = _numbered(context * len(self.c) + symbol)
        context, symbol = context[first], symbol[first]
        return Grams(keys, totals, before, at, entry, context, symbol, _mixed(keys[context] * np.uint64(0x9E3779B97F4A7C15) + self.words[symbol]))

    def train_counts(self, grams: Grams) -> np.ndarray:
        train = np.repeat(~np.array(self.row["held"], bool), self.lengths)
        return np.bincount(grams.entry[train[grams.at]], minlength=len(grams.keys))

    def sums(self, grams: Grams, signed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By context: kept counts, lower probabilities and divergence of the entries that are this chunk's to add."""
        mine, q = signed > 0, np.zeros(len(grams.keys))
        q[grams.entry] = self.chance[grams.at]
        context, n, q, size = grams.context[mine], signed[mine], q[mine], len(grams.totals)
        p = n / grams.totals[context]
        kept, lower, gain = (np.bincount(context, x, size) for x in (n, q, p * np.log(p / q)))
        return kept.astype(np.int64), lower.astype(float), gain.astype(float)

    def lengthen(self, grams: Grams, n: np.ndarray, kept: np.ndarray) -> None:
        """The probabilities of all positions with the contexts of one more length; ``kept`` is 0 where one is not retained."""
        total, mass, retained = np.maximum(grams.totals, 1), self.growth.mass, kept > 0
        back = np.where(retained, (total - kept + mass) / (total + mass), 1.0)
        some = np.flatnonzero(grams.before >= 0)
        self.chance[some] *= back[grams.before[some]]
        share = np.where(retained[grams.context], n / (total[grams.context] + mass), 0.0)
        self.chance[grams.at] += share[grams.entry]

    def replay(self) -> tuple[Grams | None, Grams | None, np.ndarray]:
        """The level to count, the counted level whose sums are unknown, and its counts; negative ones are others' to add."""
        level, last, signed = self.first(), None, np.zeros(0, np.int64)
        for depth, told in enumerate(self.told[1:], 1):
            if last is not None:  # the sums of a level come with the counts of the next
                kept = np.zeros(len(last.totals), np.int64)
                kept[self.used(last)[0]] = told["kept"]
                self.lengthen(last, np.abs(signed), kept)
                last = None
            if level is None:
                break
            last, signed = level, np.zeros(len(level.keys), np.int64)
            signed[self.order(level.keys)[0]] = told["n"]
            level = self.next(level, np.abs(signed)) if depth < self.growth.depth else None
        return level, last, signed

    def used(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """The contexts that the chunk holds, in the order of their short keys, and these."""
        used = np.flatnonzero(np.bincount(grams.before[grams.before >= 0], minlength=len(grams.totals)))
        order, short = self.order(grams.context_keys[used])
        return used[order], short


@dataclass(frozen=True)
class Learnt:
    """Numbers of the whole training part, and the bits of a short key."""

    train: int
    vocabulary: int
    bits: int


_SETS = "entry boolean, bucket int, chunk long, keys binary, n binary, total binary, q binary, gain binary"
_ANSWERS = "entry boolean, bucket int, chunk long, n binary, fresh long, part long"
BUCKET_TOKENS = 1 << 21
SPARE_BITS = 22


def _answers_of(folders: list[str], part: int) -> list[dict[int, list[dict]]]:
    """By round, the answers to each chunk of a part, in the order of buckets."""
    out = []
    for folder in folders:
        fs, path = open_store(f"{folder}/part={part}")
        rows: dict[int, list[dict]] = {}
        for file in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
            if file.path.endswith(".parquet"):
                for row in pq.read_table(file.path, filesystem=fs, partitioning=None).to_pylist():
                    rows.setdefault(row["chunk"], []).append(row)
        out.append({chunk: sorted(some, key=lambda r: r["bucket"]) for chunk, some in rows.items()})
    return out


def _told(rows: list[dict]) -> dict[str, np.ndarray]:
    """A round's answers to one chunk."""

    def values(entry: bool) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(_unsqueeze(r["n"], np.int64) for r in rows if r["entry"] == entry)])

    return {"n": values(True), "kept": values(False)}


def _each_chunk(folders: list[str], learnt: Learnt, growth: Growth, answer):
    """A function over batches of the chunk table; answers are read once per part and let go after it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["chunk"] >> 32 != part:
                    part = row["chunk"] >> 32
                    found = _answers_of(folders, part)
                yield from answer(_Chunk(row, [_told(rows.pop(row["chunk"], [])) for rows in found], learnt, growth))

    return scan


def _sent(buckets: int):
    """What a chunk adds, and asks for: counts of its words or next entries, sums of its last contexts."""
    names = [x.split()[0] for x in _SETS.split(", ")]
    kinds = [pa.bool_(), pa.int32(), pa.int64(), *[pa.binary()] * 5]

    def send(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
        sets = []
        if not chunk.told:
            order = np.argsort(chunk.words)
            sets.append((True, chunk.words[order], 64, _unsqueeze(chunk.row["counts"], np.int64)[order], []))
        else:
            level, last, signed = chunk.replay()
            bits = chunk.learnt.bits
            if level is not None:
                order, short = chunk.order(level.keys)
                sets.append((True, short, bits, chunk.train_counts(level)[order], []))
            if last is not None:
                used, short = chunk.used(last)
                kept, lower, gain = chunk.sums(last, signed)
                sets.append((False, short, bits, kept[used], [x[used] for x in (last.totals, lower, gain)]))
        for entry, keys, bits, n, sums in sets:
            high = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
            bucket = (high * np.uint64(buckets)) >> np.uint64(32)
            rows = []
            for first, end in zip(*(np.searchsorted(bucket, np.unique(bucket), side) for side in ("left", "right"))):
                steps = np.diff(keys[first:end], prepend=np.uint64(0))
                some = n[first:end] > 0  # a context to which this chunk adds nothing is only asked for
                blobs = [_squeeze(x[first:end][some]) for x in sums] or [None] * 3
                rows.append([entry, int(bucket[first]), chunk.row["chunk"], _squeeze(steps), _squeeze(n[first:end]), *blobs])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return send


def _met(floor: float, divergence: float):
    """Counts of all chunks, and of their contexts the kept counts, 0 for those that are not retained.

    Counts of entries are negative where an earlier chunk has the same entry.
    """

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        keys = [np.cumsum(_unsqueeze(x, np.uint64), dtype=np.uint64) for x in rows["keys"].to_pylist()]
        ends = np.cumsum([len(x) for x in keys])[:-1]
        _, of, first = _numbered(np.concatenate(keys))
        size = len(first)

        def sent(name: str, kind: type) -> np.ndarray:
            return np.concatenate([_unsqueeze(x, kind) for x in rows[name].to_pylist()])

        each, fresh = sent("n", np.int64), np.zeros(len(keys), np.int64)
        n = np.bincount(of, each, size).astype(np.int64)
        fresh[0] = np.count_nonzero(n)
        if rows["entry"][0].as_py():
            n[n < floor] = 0
            answer = -n[of]
            answer[first] = n
        else:
            added = of[each > 0]  # the contexts of what came with sums
            whole = np.ones(size, np.int64)
            whole[added[::-1]] = sent("total", np.int64)[::-1]
            gain, lower = (np.bincount(added, sent(name, np.float64), size) for name in ("gain", "q"))
            rest = np.maximum(0.0, 1 - n / whole)
            gain = gain + rest * np.log(np.maximum(rest, 1e-300) / np.maximum(1e-300, 1 - lower))
            answer = np.where(gain >= divergence, n, 0)[of]
        blobs = [_squeeze(x) for x in np.split(answer, ends)]
        part = np.array(rows["chunk"].to_pylist(), np.int64) >> 32
        columns = [rows["entry"], rows["bucket"], rows["chunk"], pa.array(blobs, pa.binary()), pa.array(fresh), pa.array(part)]
        return pa.table(columns, names=[x.split()[0] for x in _ANSWERS.split(", ")])

    return meet


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
    chunk.replay()
    begins, base = chunk.begins, np.log10(chunk.root)
    columns = [
        pa.array(chunk.row["doc_ids"], pa.int64()),
        pa.array(chunk.row["held"], pa.bool_()),
        pa.array(chunk.lengths),
        pa.array(np.add.reduceat((chunk.c > 0).astype(np.int64)[chunk.codes], begins)),
        pa.array(np.full(len(begins), chunk.learnt.train)),
        pa.array(np.add.reduceat(base[chunk.codes], begins)),
        pa.array(np.add.reduceat(np.log10(chunk.chance), begins)),
    ]
    whole = pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCORES.split(", ")])
    for at in range(0, len(begins), WINDOW_TOKENS):
        yield whole.slice(at, WINDOW_TOKENS)


def suffix_tree_scores(docs: DataFrame, growth: Growth = Growth(), chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Scores of all documents by a tree learnt from the documents that are not held out."""
    spark = docs.sparkSession
    chunks = staged(chunked(docs, chunk_tokens), "chunks")
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    train, tokens = (x or 0 for x in chunks.agg(F.sum("train"), F.sum(lengths)).first())
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    learnt, folders = Learnt(train, 0, min(64, tokens.bit_length() + SPARE_BITS)), []
    for turn in range(growth.depth + 2):  # words, a level each, and the last level's sums
        sets = chunks.mapInArrow(_each_chunk(folders, learnt, growth, _sent(buckets)), _SETS)
        answers = sets.groupBy("entry", "bucket").applyInArrow(_met(growth.floors(train)[1] if turn else 0, growth.divergence), _ANSWERS)
        folders = [*folders, scratch_path(spark, f"answers-{turn}")]
        with shuffles_let_go(spark):
            answers.repartition("part").write.partitionBy("part").parquet(folders[-1])
        if not turn:
            learnt = replace(learnt, vocabulary=spark.read.schema("fresh long").parquet(folders[0]).agg(F.sum("fresh")).first()[0] or 0)
    return chunks.mapInArrow(_each_chunk(folders, learnt, growth, _scored), _SCORES)
