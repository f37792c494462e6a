"""Operator 13: periodic runs of words, caught by catchers over completed power-of-two blocks.

A run of period q and exponent three or more repeats at distance q for at least 2q words, so it
holds a whole block of 2^k words, 2^(k+1) <= q < 2^(k+2), of any grid of such blocks, and that block
comes again q words later. Every completed block has a catcher: as words are appended, it compares
its fingerprint with that of the last 2^k words, at the distances of its level. Periods below 32 are
the matter of catchers over blocks of eight words. A hit is a square in the making: the suffix
comparison is advanced to both sides by bisection over fingerprints, verified on the words
themselves, and squares of one distance that overlap are one stretch, which is the run. Catchers
inside a known run do not report the multiples of its period again.

Words are appended in whole texts, and all catchers of a level are advanced together as one array;
texts of like length share an array, with a word of their own between them. Nothing is shuffled: a
text is a row, and only arrays in proportion to the longest text are held.

Cases: a null text has no words, as has an empty one; both give no run, and the hash of the empty
string. Words are bytes between white space, case and all. Null ids are kept, and their text is
taken as it is. Repeated rows are each answered. Other columns are ignored. An empty table gives an
empty result. Equal exponents are decided by start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costdocs.llm.common import text_batches, worker_cache

SCHEMA = """doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string,
 collapsed_sha256 string"""
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
SMALL_BLOCK, SMALL_PERIODS = 8, 32
RUN_CHARS = 4 << 20  # characters of texts that are handled together
HITS = 1 << 18  # comparisons at a time, in catchers of a level, are this many times eight


@dataclass(frozen=True)
class Limits:
    """What counts as a run: its length in words, and in periods (three or more)."""

    min_length: int = 24
    min_exponent: int = 3

    def __post_init__(self):
        if self.min_exponent < 3 or self.min_length < 8 * self.min_exponent:
            raise ValueError("runs have at least three periods and eight words for each of these")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    cache = worker_cache()
    if len(cache.get("run_powers", ((),))[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        cache["run_powers"] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (BASE, inverse))
    up, down = cache["run_powers"]
    return up[:n], down[:n]


class Words:
    """Word numbers of one or more texts with fingerprints of every stretch."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        x = ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        up, self.down = _powers(len(ids) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(31))) * up[:-1])])

    def prints(self, size: int) -> np.ndarray:
        """The fingerprint of the ``size`` words from each place."""
        return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]

    def _same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[a + size] - self.sums[a]) * self.down[a] == (self.sums[b + size] - self.sums[b]) * self.down[b]

    def stretches(self, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the stretch around each place in which words equal those ``distance`` later.

        Fingerprints bisect; the words decide, and where they do not agree the stretch is walked.
        """
        low, high = np.zeros(len(at), np.int64), len(self.ids) - distance - at
        while np.any(low < high):
            middle = (low + high + 1) // 2
            same = self._same(at, at + distance, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        back, high = np.zeros(len(at), np.int64), at.copy()
        while np.any(back < high):
            middle = (back + high + 1) // 2
            same = self._same(at - middle, at - middle + distance, middle)
            back, high = np.where(same, middle, back), np.where(same, high, middle - 1)
        return at - back, at + low

    def holds(self, first: int, end: int, distance: int) -> bool:
        """Whether a stretch is what it says, and reaches as far as it can."""
        ids = self.ids
        whole = np.array_equal(ids[first:end], ids[first + distance : end + distance])
        left = first == 0 or ids[first - 1] != ids[first - 1 + distance]
        return whole and left and (end + distance == len(ids) or ids[end] != ids[end + distance])

    def walked(self, at: int, distance: int) -> tuple[int, int]:
        """The stretch around a place by comparing words; empty when the place itself differs."""
        same = self.ids[: len(self.ids) - distance] == self.ids[distance:]
        if not same[at]:
            return at, at
        after, before = np.flatnonzero(~same[at:]), np.flatnonzero(~same[:at])
        return (int(before[-1]) + 1 if len(before) else 0), (at + int(after[0]) if len(after) else len(same))


def _caught(words: Words, block: int, nearest: int, farthest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, distance) at which a block comes again, for the catchers of a level, some at a time."""
    prints, n = words.prints(block), len(words.ids)
    window = farthest - nearest
    catchers = (n - block) // block + 1
    padded = np.concatenate([prints, np.zeros(max(0, (catchers - 1) * block + farthest - len(prints)), np.uint64)])
    there = np.lib.stride_tricks.sliding_window_view(padded[nearest:], window)[::block]
    step = max(1, 8 * HITS // window)
    for one in range(0, catchers, step):
        own = prints[one * block : (one + step) * block : block]
        catcher, offset = np.nonzero(there[one : one + len(own)] == own[:, None])
        at, distance = (one + catcher) * block, nearest + offset
        known = at + distance + block <= n
        yield at[known], distance[known]


class _Known:
    """The runs found so far, and for every place the longest reaching one of them."""

    def __init__(self, n: int):
        self.period, self.end, self.first = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.found: dict[tuple[int, int], int] = {}

    def unseen(self, at: np.ndarray, distance: np.ndarray, block: int) -> np.ndarray:
        q = self.period[at]
        return ~((q > 0) & (at + distance + block <= self.end[at]) & (distance % np.maximum(q, 1) == 0))

    def add(self, first: int, length: int, period: int) -> None:
        if (first, length) in self.found:
            return
        self.found[first, length] = period
        inside = slice(first, first + length)
        longer = self.end[inside] - self.first[inside] < length
        for array, value in ((self.period, period), (self.end, first + length), (self.first, first)):
            array[inside][longer] = value


def runs_of(ids: np.ndarray, longest: int, limits: Limits = Limits()) -> np.ndarray:
    """(first, length, period) of every run, ordered; ``longest`` is the length of the longest text in ``ids``."""
    if longest < limits.min_length:
        return np.zeros((0, 3), np.int64)
    words, known = Words(ids), _Known(len(ids))
    last = longest // limits.min_exponent  # the longest period that can be
    levels = [(SMALL_BLOCK, 1, min(SMALL_PERIODS, last + 1))]
    levels += [(1 << k, 2 << k, min(4 << k, last + 1)) for k in range(4, 62) if 2 << k <= last]
    for block, nearest, farthest in levels:
        for at, distance in _caught(words, block, nearest, farthest):
            # Short periods have many multiples in one level: the nearer ones come first and silence them.
            steps = np.unique(distance).tolist() if nearest == 1 else [None]
            for q in steps if len(at) else ():
                some = known.unseen(at, distance, block) & ((distance == q) if q else True)
                _grow(words, known, at[some], distance[some], limits)
    rows = np.array([(f, n, q) for (f, n), q in known.found.items()], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _grow(words: Words, known: _Known, at: np.ndarray, distance: np.ndarray, limits: Limits) -> None:
    """Advance hits to whole stretches; long enough ones are runs, those of shorter periods first."""
    first, end = words.stretches(at, distance)
    long_enough = end - first >= np.maximum(limits.min_length - distance, (limits.min_exponent - 1) * distance)
    rows = np.stack([distance, first, end, at], 1)[long_enough]
    _, one = np.unique(rows[:, :3], axis=0, return_index=True)
    for q, a, b, _ in rows[one].tolist():
        if words.holds(a, b, q):
            known.add(a, b - a + q, q)
            continue
        for place in rows[(rows[:, :3] == (q, a, b)).all(axis=1), 3].tolist():  # a fingerprint that two stretches share
            c, d = words.walked(place, q)
            if d - c >= max(limits.min_length - q, (limits.min_exponent - 1) * q):
                known.add(c, d - c + q, q)


def as_is(doc_id: int | None, n: int) -> np.ndarray | None:
    """No change: every word stays in its place."""
    return None


def with_planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places to take a text's words from: a tenth of the texts, by id, repeats a stretch to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """The result columns of one text."""
    if not len(runs):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    first, length, period = runs.T
    best = np.lexsort((period, first, -(length / period)))[0]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first + period, 1)
    np.add.at(edge, first + length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    listed = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs.tolist()).encode()).hexdigest()
    collapsed = hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest()
    a, n, q = runs[best].tolist()
    return len(runs), a, n, q, 1000 * n // q, listed, collapsed


class _Numbers(dict):
    """Words numbered in order of first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def text_runs(doc_ids: list, texts: list[str | None], places=as_is, limits: Limits = Limits()) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, runs) of each text; texts of like length are searched together."""
    number = _Numbers().__getitem__
    split, ids = [], []
    for doc_id, text in zip(doc_ids, texts):
        words = (text or "").encode().split()
        own = np.fromiter(map(number, words), np.int64, len(words))
        moved = places(doc_id, len(words))
        if moved is not None:
            own, words = own[moved], [words[i] for i in moved.tolist()]
        split.append(words)
        ids.append(own)
    runs = [np.zeros((0, 3), np.int64)] * len(texts)
    classes: dict[int, list[int]] = {}
    for i, own in enumerate(ids):
        if len(own) >= limits.min_length:
            classes.setdefault((len(own) // 96).bit_length(), []).append(i)
    for members in classes.values():
        # A number that nothing else has ends each text, so that no stretch reaches over it.
        parts = [np.append(ids[i], -1 - i) for i in members]
        starts = np.cumsum([0, *map(len, parts)])
        found = runs_of(np.concatenate(parts), max(map(len, parts)) - 1, limits)
        owner = np.searchsorted(starts, found[:, 0], "right") - 1
        cut = np.searchsorted(owner, np.arange(len(members) + 1))
        for j, i in enumerate(members):
            runs[i] = found[cut[j] : cut[j + 1]] - np.array([starts[j], 0, 0])
    yield from zip(split, runs)


def _answers(places, limits: Limits):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [part.split()[0] for part in SCHEMA.split(",")]
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, texts in text_batches(batch, "text", RUN_CHARS):
                some = ids[at : at + len(texts)]
                rows = [(i, *_digest(*found)) for i, found in zip(some, text_runs(some, texts, places, limits))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return answer


def periodic_runs(docs: DataFrame, places=as_is, limits: Limits = Limits()) -> DataFrame:
    """Per text: number of runs, the one of greatest exponent, and hashes of all runs and of the text without them.

    A word is left out when a run holds it after the run's first period. ``places`` may give, for an
    id and a number of words, the places that the words are taken from.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_answers(places, limits), SCHEMA)


def collapsed(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents with all but the first period of their runs left out; texts without a run stay as they are."""

    at = docs.columns.index("text")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, texts in text_batches(batch, "text", RUN_CHARS):
                for text, (words, runs) in zip(texts, text_runs([None] * len(texts), texts, as_is, limits)):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    out.append(b" ".join([words[i] for i in kept]).decode() if len(runs) else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(shorten, docs.schema)
