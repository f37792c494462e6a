"""Operator 3: packing documents into sequences of at most 2048 tokens.

Lengths are whole numbers up to the capacity, so the instance is a histogram with one count per
length, however many documents there are. The histogram is shrunk by Martello-Toth dominance:
a bin that provably dominates all others for the longest piece is fixed for as many pieces as
there are. The rest is packed best-fit, longest first, with equal bins handled together. The
plan says how many pieces of a length go to which bins; pieces are numbered per length, and
each takes the place of its number.

Cases: a null text is an empty one, which has its end id only. Repeated rows, equal ids and null
ids are packed row by row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costdocs.llm.common import staged, text_batches
from costdocs.llm.tokens import encoder, vocabulary, with_end

CAPACITY = 2048


@dataclass
class Bins:
    """``count`` bins that hold the same lengths in the same order."""

    count: int
    lengths: tuple[int, ...]


def _dominant(counts: np.ndarray, top: int, capacity: int) -> tuple[int, ...] | None:
    """The lengths that may be fixed beside the longest piece ``top``, or None if no set dominates.

    ``counts`` is without the piece itself. Every set that fits beside it must be replaceable,
    piece by piece, by a part of the one that is returned.
    """
    room = capacity - top
    sizes = np.flatnonzero(counts[: room + 1])
    if not len(sizes):
        return ()
    best = int(sizes[-1])
    smallest = int(sizes[0])
    second = smallest if counts[smallest] > 1 else (int(sizes[1]) if len(sizes) > 1 else capacity)
    if best == room or smallest + second > room:
        return (best,)
    third = smallest if counts[smallest] > 2 else (second if second > smallest and counts[second] > 1 else None)
    if third is None:
        third = int(sizes[2]) if len(sizes) > 2 and second > smallest else (int(sizes[1]) if len(sizes) > 1 and second == smallest else capacity)
    if smallest + second + third <= room:
        return None
    # At most two more pieces fit. A pair that holds the largest piece that fits and, beside it, the
    # largest that is left dominates if no other pair can have a larger second piece.
    pair, high, low = 0, 0, 0
    for a in sizes[::-1].tolist():
        limit = room - a
        if limit < smallest:
            continue
        fit = sizes[sizes <= min(limit, a)]
        fit = fit[(fit != a) | (counts[fit] > 1)]
        if len(fit) and a + int(fit[-1]) > pair:
            pair, high, low = a + int(fit[-1]), a, int(fit[-1])
    if best >= pair:
        return (best,)
    if high == best and low == _largest_second(sizes, counts, room):
        return (high, low)
    return None


def _largest_second(sizes: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest smaller piece of any pair that fits."""
    for b in sizes[::-1].tolist():
        partner = sizes[sizes >= b]
        partner = partner[(partner != b) | (counts[partner] > 1)]
        if len(partner) and b + int(partner[0]) <= room:
            return b
    return 0


def reduce_instance(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Bins], np.ndarray]:
    """Bins that may be fixed for good, and the counts that remain.

    Pieces without a dominating set are passed over. The set holds for as long as none of its
    lengths runs short, so it is taken that many times at once, and one at a time near the end.
    """
    counts, fixed = counts.copy(), []
    for top in range(capacity, 0, -1):
        while counts[top]:
            counts[top] -= 1
            beside = _dominant(counts, top, capacity)
            counts[top] += 1
            if beside is None:
                break
            use = np.bincount([top, *beside], minlength=capacity + 1)
            need = np.flatnonzero(use)
            spare = counts - 3 if len(beside) else counts
            times = max(1, int((spare[need] // use[need]).min()))
            counts[need] -= times * use[need]
            fixed.append(Bins(times, (top, *beside)))
    return fixed, counts


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[Bins]:
    """Best-fit, longest first, on equal bins at a time."""
    open_bins: dict[int, list[Bins]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        room = length
        while left:
            while room <= capacity and not open_bins.get(room):
                room += 1
            if room > capacity:
                fit = capacity // length
                whole, rest = divmod(left, fit)
                if whole:
                    open_bins.setdefault(capacity - fit * length, []).append(Bins(whole, (length,) * fit))
                if rest:
                    open_bins.setdefault(capacity - rest * length, []).append(Bins(1, (length,) * rest))
                break
            # The fullest bin takes pieces until none fits, and the next equal bin does the same.
            group = open_bins[room].pop()
            fit = room // length
            whole = min(group.count, left // fit)
            rest = left % fit if whole < group.count and left < (whole + 1) * fit else 0
            for bins, pieces in ((whole, fit), (1 if rest else 0, rest), (group.count - whole - (1 if rest else 0), 0)):
                if bins:
                    open_bins.setdefault(room - pieces * length, []).append(Bins(bins, group.lengths + (length,) * pieces))
            left -= whole * fit + rest
    return [group for groups in open_bins.values() for group in groups]


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[Bins]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def plan_slots(bins: list[Bins]) -> dict[str, np.ndarray]:
    """Runs of pieces by length and number: where a run begins, and the places it fills.

    Run i serves the pieces of its length numbered from ``first``; in every bin of its group it
    has ``per_bin`` places from ``offset`` on.
    """
    rows, taken, sequence = [], {}, 0
    for group in bins:
        at = 0
        for length in dict.fromkeys(group.lengths):
            per_bin = group.lengths.count(length)
            first = taken.get(length, 0)
            rows.append((length, first, sequence, per_bin, at))
            taken[length] = first + per_bin * group.count
            at += per_bin * length
        sequence += group.count
    rows.sort()
    names = ("length", "first", "sequence", "per_bin", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T))


def piece_lengths(total: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces per document, lengths of all pieces); only the first piece may be shorter."""
    pieces = -(-total // capacity)
    lengths = np.full(pieces.sum(), capacity, np.int64)
    lengths[np.cumsum(pieces) - pieces] = total - (pieces - 1) * capacity
    return pieces, lengths


def tokenized_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with the task that made them and their number among its pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids_of = batch.column("doc_id")
            for first, texts in text_batches(batch, "text"):
                total, ids = with_end(*encode(texts), end)
                pieces, lengths = piece_lengths(total, capacity)
                ends = np.cumsum(lengths)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                of = np.repeat(np.arange(len(texts)), pieces)
                begin = ends - lengths
                number = np.arange(len(lengths)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                columns = {
                    "doc_id": ids_of.take(pa.array(first + of)),
                    "piece": pa.array(number.astype(np.int32)),
                    "start": pa.array(begin - np.repeat(np.cumsum(total) - total, pieces)),
                    "length": pa.array(lengths),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "part": pa.array(np.full(len(lengths), part, np.int32)),
                    "nth": pa.array(_number_equal(lengths, seen)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _number_equal(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of every piece among those of its length, counted on from ``seen``."""
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    number = np.empty(len(lengths), np.int64)
    number[order] = np.arange(len(lengths)) - np.searchsorted(ranked, ranked) + seen[ranked]
    seen += np.bincount(lengths, minlength=len(seen))
    return number


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` of every piece of a staged table of pieces.

    Only the histogram, at most ``capacity`` rows, comes to the driver, and the plan, whose
    size depends on the capacity alone, goes to the tasks.
    """
    per_part = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots = plan_slots(plan_bins(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-bases")
    # Both sides grow with the number of tasks, and file sizes say little about them: neither is broadcast.
    numbered = pieces.join(bases.hint("merge"), ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sorted key per run: lengths are below 2^16, numbers below 2^47.
        keys = (slots["length"] << 47) + slots["first"]
        for batch in batches:
            length, base, nth = (batch.column(c).to_numpy() for c in ("length", "base", "nth"))
            run = np.searchsorted(keys, (length << 47) + base + nth, "right") - 1
            number = base + nth - slots["first"][run]
            sequence = slots["sequence"][run] + number // slots["per_bin"][run]
            offset = slots["offset"][run] + number % slots["per_bin"][run] * length
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All documents, tokenized with the byte-level vocabulary, packed."""
    pieces = staged(tokenized_pieces(docs, vocabulary("byte_bpe_50k.json"), 0, capacity), "pieces")
    return pack(pieces, capacity)
