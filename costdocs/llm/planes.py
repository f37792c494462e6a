"""Operator 1: token ids in shard files of bit or byte planes.

File: magic, the compressed planes of one block of ids after the other, a zstandard-compressed
JSON index, the index length as eight little-endian bytes, magic. A block holds a fixed number
of ids (the last one fewer); plane p of a block holds bit p (or byte p) of all its ids, lowest
first, and planes above the highest set bit are not stored. The index lists every block (offset,
ids, plane lengths) and every document (id, tokens), so a block is read without the others.

Cases: a null text is an empty one, which has its end id only. Null document ids come first.
Rows with the same id follow each other in the order of their texts' hashes; each keeps its own
tokens. An empty table writes no files. Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costdocs.llm.common import open_store, small_batches, staged, text_batches, write_then_rename
from costdocs.llm.tokens import encoder, vocabulary, with_end
from costdocs.sources.scratch import scratch_path

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 24
SHARD_DOCS = 1 << 19


@dataclass(frozen=True)
class Format:
    block_ids: int = BLOCK_IDS
    unit: str = "bit"  # or "byte"
    level: int = 3


def split_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of a block, lowest first."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if unit == "byte":
        raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        return [raw[:, p].tobytes() for p in range(-(-bits // 8))]
    return [np.packbits(((ids >> np.uint32(p)) & np.uint32(1)).astype(np.uint8)).tobytes() for p in range(bits)]


def join_planes(planes: list[bytes], count: int, unit: str) -> np.ndarray:
    ids = np.zeros(count, np.uint32)
    for p, plane in enumerate(planes):
        values = np.frombuffer(plane, np.uint8)
        if unit == "bit":
            ids |= np.unpackbits(values, count=count).astype(np.uint32) << np.uint32(p)
        else:
            ids |= values.astype(np.uint32) << np.uint32(8 * p)
    return ids


class _Shard:
    """One file being written: blocks go out as they fill up."""

    def __init__(self, out, form: Format):
        import zstandard

        self.out, self.form, self.offset = out, form, len(MAGIC)
        self.compress = zstandard.ZstdCompressor(level=form.level).compress
        self.blocks, self.docs, self.lengths = [], [], []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        out.write(MAGIC)

    def add(self, docs: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs += docs
        self.lengths += lengths.tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.form.block_ids:
            rest = np.concatenate(self.waiting)
            full = len(rest) // self.form.block_ids * self.form.block_ids
            for at in range(0, full, self.form.block_ids):
                self._block(rest[at : at + self.form.block_ids])
            self.waiting, self.n_waiting = [rest[full:]], len(rest) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.compress(p) for p in split_planes(ids, self.form.unit)]
        self.blocks.append([self.offset, len(ids), [len(p) for p in planes]])
        for plane in planes:
            self.out.write(plane)
            self.offset += len(plane)

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        head = {"unit": self.form.unit, "blocks": self.blocks, "docs": self.docs, "lengths": self.lengths}
        index = self.compress(json.dumps(head).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


def read_index(file) -> dict:
    import zstandard

    size = file.size()
    tail = file.read_at(16, size - 16)
    if tail[8:] != MAGIC:
        raise ValueError("not a plane file")
    length = int.from_bytes(tail[:8], "little")
    return json.loads(zstandard.ZstdDecompressor().decompress(file.read_at(length, size - 16 - length)))


def read_block(file, index: dict, number: int) -> np.ndarray:
    """The ids of one block, read on its own."""
    import zstandard

    offset, count, lengths = index["blocks"][number]
    raw, at, planes = file.read_at(sum(lengths), offset), 0, []
    for length in lengths:
        planes.append(zstandard.ZstdDecompressor().decompress(raw[at : at + length]))
        at += length
    return join_planes(planes, count, index["unit"])


def write_planes(
    docs: DataFrame, path: str, tokenizer: str, end: int, form: Format = Format(), shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Writes the ids of all texts in ascending ``doc_id`` order; one row per shard file.

    The documents are range-partitioned by id, so every task writes a run of them, and shard
    (part, seq) comes before the next. Files of a failed attempt stay unlisted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_store(path)
        part, encode, shard, rows = TaskContext.get().partitionId(), encoder(tokenizer).encode, None, []

        def close():
            shard.close()
            context.__exit__(None, None, None)
            rows.append((part, len(rows), name, shard.n_ids, len(shard.docs)))

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for first, texts in text_batches(batch, "text"):
                if shard is None:
                    name = f"{part:08d}-{len(rows):04d}-{uuid.uuid4().hex}.planes"
                    context = write_then_rename(fs, f"{folder}/{name}")
                    shard = _Shard(context.__enter__(), form)
                lengths, ids = with_end(*encode(texts), end)
                shard.add(ids_of[first : first + len(texts)], lengths, ids)
                if shard.n_ids >= shard_ids or len(shard.docs) >= SHARD_DOCS:
                    close()
                    shard = None
        if shard is not None:
            close()
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names = ["part", "seq", "file", "n_ids", "n_docs"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    shards = rows.mapInArrow(write, "part int, seq int, file string, n_ids long, n_docs long")
    with small_batches(docs.sparkSession):
        manifest = staged(shards, "plane-shards")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_planes(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; a task reads whole shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_store(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{row['file']}") as file:
                    index = read_index(file)
                    yield _documents(file, index, row["start"])

    def _documents(file, index: dict, start: int) -> pa.RecordBatch:
        lengths = np.array(index["lengths"], np.int64)
        crcs, done, left = [], 0, lengths.copy()
        crc = 0
        for number in range(len(index["blocks"])):
            raw = memoryview(np.ascontiguousarray(read_block(file, index, number), "<u4")).cast("B")
            at = 0
            while at < len(raw):
                take = min(int(left[done]) * 4, len(raw) - at)
                crc = zlib.crc32(raw[at : at + take], crc)
                at += take
                left[done] -= take // 4
                if left[done] == 0:
                    crcs.append(crc)
                    crc, done = 0, done + 1
        starts = start + np.cumsum(lengths) - lengths
        return pa.RecordBatch.from_arrays(
            [pa.array(index["docs"], pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    tasks = max(1, manifest.count())
    return manifest.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def plane_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All documents written with the word-piece vocabulary and read back."""
    path = scratch_path(spark, "planes")
    manifest = write_planes(docs, path, vocabulary("word_bpe_49k.json"), 2)
    return read_planes(spark, path, manifest)
