"""Operator 9: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint becomes the vector of the bit counts of its 32 two-bit segments. The Manhattan
distance of two vectors never exceeds the number of differing bits, so fingerprints within four
bits have vectors within four, and then one half of the vector within two. Two points within two
on the grid of a half have a grid point between them that is at most one step from each; every
fingerprint is therefore entered at its own grid point and at the neighbouring ones of both
halves, and all links meet in a cell. Cells compare their vectors' distance first and verify the
bits exactly. A cell that may hold very many fingerprints is dealt out as pairs of blocks.

Cases: a null text is an empty one; without words the fingerprint is zero, linked like any
other. Null ids count last when the smallest of a component is looked for; a component of null
ids only has a null id. Repeated rows are copies like any others. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costdocs.llm.common import staged, text_batches
from costdocs.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
HOME_LIMIT = 512  # fingerprints at one grid point beyond which its neighbours are dealt as blocks
BLOCK = 4096
SMALL_RUN = 32
_PAIRS = np.uint64(0x5555555555555555)
_HALF = np.uint64(0xFFFFFFFF)


def fingerprint_bits(raw: bytes, words: int = SHINGLE_WORDS, window: int = 1 << 16) -> int:
    """The fingerprint of a UTF-8 text: bit i is set if it is set in over half the shingle hashes."""
    import xxhash

    found = raw.lower().split()
    if not found:
        return 0
    whole = memoryview(b" ".join(found))
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    take = min(words, len(found))
    begin, end = starts[: len(found) - take + 1].tolist(), ends[take - 1 :].tolist()
    one, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(begin), window):
        hashes = [one(whole[a:b], SEED) for a, b in zip(begin[at : at + window], end[at : at + window])]
        counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(begin), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; ``text_hash`` tells texts under one id apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for _, texts in text_batches(batch, "text"):
                fps += [fingerprint_bits((t or "").encode(), words) for t in texts]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return rows.mapInArrow(scan, "doc_id long, text_hash long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The bit counts of all two-bit segments, two bits for each, in one number."""
    fps = fps.astype(np.int64).view(np.uint64)
    return fps - ((fps >> np.uint64(1)) & _PAIRS)


def grid_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): every fingerprint's grid points, and their neighbours, in both halves.

    A cell is a half's vector of counts with the number of the half above it. The first 2n cells
    are the fingerprints' own ones.
    """
    counts = segment_counts(fps)
    halves = [counts & _HALF, (counts >> np.uint64(32)) | np.uint64(1 << 32)]
    rows, cells = [np.arange(len(fps))] * 2, list(halves)
    for half in halves:
        for segment in range(16):
            value = (half >> np.uint64(2 * segment)) & np.uint64(3)
            step = np.uint64(1 << (2 * segment))
            for allowed, moved in ((value < 2, half + step), (value > 0, half - step)):
                rows.append(np.flatnonzero(allowed))
                cells.append(moved[allowed])
    return np.concatenate(rows), np.concatenate(cells).view(np.int64)


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are within the distance: the vectors' distance first, as it is never larger."""
    x, y = segment_counts(a), segment_counts(b)
    three = np.uint64(0x3333333333333333)
    apart = np.zeros(np.broadcast(a, b).shape, np.uint8)
    for shift in (np.uint64(0), np.uint64(2)):
        # Fields of four bits hold 4 + x - y: odd for a distance of one, 2 or 6 for a distance of two.
        delta = ((x >> shift) & three) + np.uint64(0x4444444444444444) - ((y >> shift) & three)
        odd = delta & np.uint64(0x1111111111111111)
        two = (delta >> np.uint64(1)) & ~delta & np.uint64(0x1111111111111111)
        apart += np.bitwise_count(odd).astype(np.uint8) + 2 * np.bitwise_count(two).astype(np.uint8)
    near = apart <= max_bits
    return near & (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits)


def _links_of_large(run: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The components of one cell as a star each, without a list of its pairs."""
    label = np.arange(len(run))
    step = max(1, (1 << 22) // len(run))
    while True:
        before = label.copy()
        for at in range(0, len(run), step):
            near = _linked(run[at : at + step, None], run[None, :], max_bits)
            least = np.where(near, label[None, :], len(run)).min(1)
            np.minimum.at(label, label[at : at + step].copy(), least)
            label[at : at + step] = np.minimum(label[at : at + step], least)
        label = label[label]
        if (label == before).all():
            other = np.flatnonzero(label != np.arange(len(run)))
            return run[other], run[label[other]]


def cell_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; sorted by key."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    found = []
    for at in np.flatnonzero(sizes > SMALL_RUN):
        found.append(_links_of_large(np.unique(fps[heads[at] : heads[at] + sizes[at]]), max_bits))
    kept = np.repeat(sizes <= SMALL_RUN, sizes)
    keys, fps = keys[kept], fps[kept]
    for shift in range(1, min(SMALL_RUN, len(keys))):
        same = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(same):
            break
        a, b = fps[same], fps[same + shift]
        near = _linked(a, b, max_bits) & (a != b)
        found.append((a[near], b[near]))
    u = np.concatenate([np.maximum(a, b) for a, b in found]) if found else np.zeros(0, np.int64)
    v = np.concatenate([np.minimum(a, b) for a, b in found]) if found else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fps = batch.column("fp").to_numpy()[at : at + 20_000]
            row, cell = grid_cells(fps)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fps[row])], names=["cell", "fp"])


def _home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        _, cell = grid_cells(fps)
        own, count = np.unique(cell[: 2 * len(fps)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count)], names=["cell", "n"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A full grid point's count, given to it and to its neighbours."""
    for batch in batches:
        cell, n = batch.column("cell").to_numpy(), batch.column("n").to_numpy()
        half = cell & 0xFFFFFFFF
        cells, counts = [cell], [n]
        for segment in range(16):
            value = (half >> (2 * segment)) & 3
            for allowed, step in ((value < 2, 1), (value > 0, -1)):
                cells.append(cell[allowed] + step * (1 << (2 * segment)))
                counts.append(n[allowed])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(counts))], names=["cell", "n"])


def near_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v), u > v, that join all distinct fingerprints (fp) within ``max_bits`` ≤ 4 bits.

    Small cells give every link, large ones the stars of their components, so a group of many
    near copies never becomes all of its pairs.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be between 0 and {MAX_BITS}")
    homes = fps.mapInArrow(_home, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > HOME_LIMIT)
    # At most 33 grid points meet in a cell; those that are not listed add HOME_LIMIT each.
    full = homes.mapInArrow(_around, "cell long, n long").groupBy("cell").agg(
        F.ceil((F.sum("n") + 33 * HOME_LIMIT) / BLOCK).cast("int").alias("blocks")
    )
    full = staged(full, "full-cells")
    entered = fps.mapInArrow(_enter, "cell long, fp long").join(full, "cell", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    )
    dealt = entered.select("cell", F.explode(tiles).alias("tile"), "fp")
    sorted_cells = dealt.repartition("cell", "tile").sortWithinPartitions("cell", "tile").select("cell", "tile", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last run may go on in the next batch
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "tile", "fp")])
            now = now if rest is None else np.concatenate([rest, now], 1)
            if not now.shape[1]:
                continue
            new = np.flatnonzero((now[:2, 1:] != now[:2, :-1]).any(0))
            cut = new[-1] + 1 if len(new) else 0
            rest = now[:, cut:]
            yield links(now[:, :cut])
        if rest is not None:
            yield links(rest)

    def links(run: np.ndarray) -> pa.RecordBatch:
        changed = np.concatenate([[0], (run[:2, 1:] != run[:2, :-1]).any(0)]) if run.shape[1] else np.zeros(0)
        u, v = cell_links(np.cumsum(changed), run[2], max_bits) if run.shape[1] else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return sorted_cells.mapInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root) of every row; rows of one component share ``root``."""
    rows = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(rows.select("fp").distinct(), "distinct-fingerprints")
    roots = staged(components(near_pairs(distinct, max_bits)).withColumnRenamed("node", "fp"), "roots")
    return rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = staged(near_duplicates(docs, words, max_bits), "rooted")
    least = staged(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return rows.join(least, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without their near copies: of every component the row with the smallest id stays.

    Null ids come last, equal ids are told apart by their text; of rows equal in both, the one whose
    columns come first in order stays. Only such rows are grouped; the texts of others move once.
    """
    rows = near_duplicates(docs, words, max_bits)
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    equal = rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("equal"))
    kept = equal.groupBy("root").agg(F.min(F.struct(first.alias("first"), "equal")).alias("kept"))
    kept = staged(kept.select(F.col("kept.first.doc_id").alias("_kept_id"), F.col("kept.first.text_hash").alias("_kept_hash"), F.col("kept.equal").alias("_equal")), "kept")
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = keyed["doc_id"].eqNullSafe(kept["_kept_id"]) & (keyed["_text_hash"] == kept["_kept_hash"])
    found = keyed.join(kept, same)
    one = found.where("_equal = 1").select(*docs.columns)
    several = found.where("_equal > 1").groupBy("_kept_id", "_kept_hash").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return one.unionByName(several.select("row.*"))
