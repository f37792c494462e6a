"""Operator 11: the languages of a text as a mixture, by expectation-maximisation.

A text is a bag of letter trigrams, taken over words in lower case with their borders. Each learned
language gives a trigram's share in its own texts; a small part of every language is the even share,
so that what no language knows speaks for none. The shares of all labelled training texts are
counted, merged in the map tasks, and stored once in the shared folder, from which every Python
worker reads them.

A text's set of languages grows from its best single one. The next candidate is the language whose
part would raise the likelihood fastest; the likelihood is concave, so the number of trigrams times
that slope less one bounds what it can gain, and no estimation is run where that is not more than
the penalty. Otherwise expectation-maximisation estimates the parts over the larger set, and the
candidate stays when the likelihood gains more than the penalty, ``penalty * log(trigrams)``. The
predicted language is the one of the largest part, which is the score.

Cases: a null text, or one without a letter, is ``und`` with score 0, as is every text where no
language was learned. Texts without a language teach nothing. Null ids count as the empty text: they
are not held out. Equal parts go to the language of smaller code points. Repeated rows are each
counted and answered. Other columns are ignored; an empty table gives an empty result. Very long
texts are taken in windows. A worker holds 512 KB a language, so the number of languages is meant
to be hundreds, not millions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costdocs.llm.common import staged_path, text_batches, worker_cache
from costdocs.sources.scratch import open_files

UNKNOWN = "und"
SLOTS = 1 << 16  # trigrams share this many counters
RUN_CHARS = 1 << 20  # characters of texts that are handled together
WINDOW = 1 << 21  # characters of a very long text that are taken at a time
HELD = 64  # languages whose counts a training task holds before it hands them on
COUNTS = "lang string, slot int, n long"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, parts array<double>, n_trigrams long"


@dataclass(frozen=True)
class Mixture:
    """The even share in every language, the price of one more language, and when estimation ends."""

    even: float = 0.02
    penalty: float = 3.0
    rounds: int = 40
    enough: float = 1e-6

    def __post_init__(self):
        if not 0 < self.even < 1 or self.penalty < 0:
            raise ValueError("the even share lies between 0 and 1, the penalty is not negative")


def _letters() -> np.ndarray:
    """For every code point its small letter, or 0 where it is no letter or mark of one."""
    cache = worker_cache()
    if "letters" not in cache:
        import unicodedata

        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                small = c.lower()
                out[i] = ord(small) if len(small) == 1 else i
            elif i >= 0x300 and unicodedata.category(c)[0] == "M":
                out[i] = i
        cache["letters"] = out
    return cache["letters"]


def _slots(symbols: np.ndarray) -> np.ndarray:
    """The counter of the trigram around each symbol but the first and last."""
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) + np.uint32(0x7F4A7C15))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) ^ (c * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39)
    return h >> np.uint32(16)


def _symbols(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def _kept(symbols: np.ndarray) -> np.ndarray:
    """Letters, and the first of several signs that are none."""
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    keep[0] = True
    return keep


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, counter, number) of the trigrams of texts; none for a text without a letter."""
    short = [t or "" if len(t or "") <= WINDOW else "" for t in texts]
    lengths = np.fromiter(map(len, short), np.int64, len(short)) + 1
    symbols = np.concatenate([np.zeros(1, np.uint32), _symbols("\n".join(short) + "\n")])
    owner = np.concatenate([np.zeros(1, np.int64), np.repeat(np.arange(len(short)), lengths)])
    keep = _kept(symbols)
    symbols, owner = symbols[keep], owner[keep]
    inner = symbols[1:-1] != 0
    keys = owner[1:-1][inner] * SLOTS + _slots(symbols)[inner]
    keys, n = np.unique(keys, return_counts=True)
    rows, slots = np.divmod(keys, SLOTS)
    for i, text in enumerate(texts):
        if text and len(text) > WINDOW:
            counts = _long_counts(text)
            at = np.searchsorted(rows, i)
            own = np.flatnonzero(counts)
            rows, slots, n = (np.insert(x, at, y) for x, y in ((rows, np.full(len(own), i)), (slots, own), (n, counts[own])))
    lettered = np.fromiter((has_letter(t) if t else False for t in texts), bool, len(texts))
    known = lettered[rows]  # marks alone make no word
    return rows[known], slots[known], n[known]


def _long_counts(text: str) -> np.ndarray:
    counts, before = np.zeros(SLOTS, np.int64), np.zeros(1, np.uint32)
    for at in range(0, len(text) + 1, WINDOW):
        window = text[at : at + WINDOW]
        symbols = np.concatenate([before, _symbols(window if at + WINDOW <= len(text) else window + "\n")])
        symbols = symbols[_kept(symbols)]
        counts += np.bincount(_slots(symbols)[symbols[1:-1] != 0], minlength=SLOTS)
        before = symbols[-2:]
    return counts


# ---- learning ----------------------------------------------------------------------------


def held_out(doc_id, folds: int = 3, fold: int = 1):
    """Whether a document is left out of learning, by the CRC-32 of its id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            slots = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(counts[slots], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "slot", "n"])
        found.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for at, texts in text_batches(batch, "text", RUN_CHARS):
            rows, slots, n = trigrams(texts)
            names, number = np.unique(np.array(langs[at : at + len(texts)], object), return_inverse=True)
            for i, lang in enumerate(names.tolist()):
                own = number[rows] == i
                # Weights are sums of whole numbers far below 2^53, so they are exact.
                found[lang] = found.get(lang, 0) + np.bincount(slots[own], n[own], SLOTS).astype(np.int64)
            if len(found) > HELD:
                yield from handed_on()
    yield from handed_on()


def learn(docs: DataFrame, lang: str = "lang") -> str:
    """Count the trigrams of every labelled text; the folder in which the counts are."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.where("text is not null and lang is not null").mapInArrow(_counted, COUNTS)
    total = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return staged_path(total, "language-counts")


def _model(folder: str, even: float) -> tuple[list[str], np.ndarray]:
    """(languages in order, share of each counter in each) of stored counts; read once per worker."""
    cache = worker_cache()
    key = ("languages", folder, even)
    if key not in cache:
        fs, files = open_files(folder)
        # One file at a time: no more than its rows are held beside the shares.
        counts: dict[str, np.ndarray] = {}
        for file in files:
            rows = pq.read_table(file, filesystem=fs)
            names = rows["lang"].combine_chunks().dictionary_encode()
            slots, n, number = rows["slot"].to_numpy(), rows["n"].to_numpy(), names.indices.to_numpy()
            for i, lang in enumerate(names.dictionary.to_pylist()):
                own = number == i
                counts.setdefault(lang, np.zeros(SLOTS))[slots[own]] += n[own]
        langs = sorted(counts)  # by code point
        shares = np.array([counts[lang] / counts[lang].sum() for lang in langs]).reshape(-1, SLOTS)
        cache[key] = langs, np.ascontiguousarray(((1 - even) * shares + even / SLOTS).T)
    return cache[key]


# ---- mixtures ----------------------------------------------------------------------------


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _estimated(shares: np.ndarray, n: np.ndarray, starts: np.ndarray, parts: np.ndarray, how: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """(parts, log likelihood) of texts after expectation-maximisation from ``parts``.

    A row of ``shares`` is a trigram of a text in the text's languages; ``starts`` are the first rows of the texts.
    """
    sizes = np.diff(np.append(starts, len(n)))
    of = np.repeat(np.arange(len(starts)), sizes)
    total, ended = _sums(n, starts), np.zeros(len(starts), bool)
    for _ in range(how.rounds):
        joint = parts[of] * shares
        new = _sums(joint * (n / joint.sum(1))[:, None], starts) / total[:, None]
        # Every text ends by itself, whatever it is handled with.
        moved = np.abs(new - parts).max(1)
        parts = np.where(ended[:, None], parts, new)
        ended |= moved < how.enough
        if ended.all():
            break
    return parts, _sums(n * np.log((parts[of] * shares).sum(1)), starts)


def mixtures(rows: np.ndarray, slots: np.ndarray, n: np.ndarray, size: int, shares: np.ndarray, how: Mixture) -> np.ndarray:
    """The part of every language in each of ``size`` texts; zeros for a text without trigrams."""
    out = np.zeros((size, shares.shape[1]))
    if not len(rows) or not shares.shape[1]:
        return out
    here, starts = np.unique(rows, return_index=True)
    p, n = shares[slots], n.astype(float)
    alone = _sums(n[:, None] * np.log(shares)[slots], starts)
    best = alone.argmax(1)
    out[here, best] = 1
    likelihood = alone[np.arange(len(here)), best]
    total = _sums(n, starts)
    price = how.penalty * np.log(total)
    growing = np.arange(len(here))
    ends = np.append(starts[1:], len(n))
    while len(growing):
        lengths = ends[growing] - starts[growing]
        picked = np.repeat(starts[growing] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        first = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(growing)), lengths)
        own, count = p[picked], n[picked]
        parts = out[here[growing]]
        slope = _sums(own * (count / (parts[of] * own).sum(1))[:, None], first) / total[growing, None]
        slope[parts > 0] = -np.inf
        candidate = slope.argmax(1)
        gain = total[growing] * (slope[np.arange(len(growing)), candidate] - 1)
        go = gain > price[growing]
        if not go.any():
            break
        mask = go[of]
        growing, candidate, parts, lengths = growing[go], candidate[go], parts[go], lengths[go]
        members = parts > 0
        members[np.arange(len(growing)), candidate] = True
        start = np.where(members, np.where(parts > 0, parts * 0.9, 0.1), 0.0)
        # Only the columns that some text here has.
        used = np.flatnonzero(members.any(0))
        new, after = _estimated(own[mask][:, used], count[mask], np.cumsum(lengths) - lengths, start[:, used], how)
        better = after - likelihood[growing] > price[growing]
        growing = growing[better]
        grown = np.zeros((len(growing), out.shape[1]))
        grown[:, used] = new[better]
        out[here[growing]] = grown
        likelihood[growing] = after[better]
        growing = growing[(out[here[growing]] > 0).sum(1) < out.shape[1]]
    return out


def _predicted(folder: str, how: Mixture):
    names = ["doc_id", "held_out", "lang_pred", "score", "langs", "parts", "n_trigrams"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, shares = _model(folder, how.even)
        for batch in batches:
            for at, texts in text_batches(batch, "text", RUN_CHARS):
                rows, slots, n = trigrams(texts)
                parts = mixtures(rows, slots, n, len(texts), shares, how)
                of, place = np.nonzero(parts)
                order = np.lexsort((place, -parts[of, place], of))
                of, place = of[order], place[order]
                offsets = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
                named = pa.array([langs[i] for i in place.tolist()], pa.string())
                score = parts.max(1, initial=0.0)
                best = [langs[i] if s else UNKNOWN for i, s in zip(parts.argmax(1).tolist() if langs else [0] * len(texts), score.tolist())]
                some = batch.slice(at, len(texts))
                columns = [
                    some.column("doc_id"), some.column("held_out"), pa.array(best, pa.string()), pa.array(np.minimum(score, 1.0)),
                    pa.ListArray.from_arrays(offsets, named), pa.ListArray.from_arrays(offsets, pa.array(parts[of, place])),
                    pa.array(np.bincount(rows, n, len(texts)).astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return predict


def languages(docs: DataFrame, counts: str, how: Mixture = Mixture()) -> DataFrame:
    """Language, its part, and all languages with their parts, largest first, of every document.

    ``counts`` is what :func:`learn` gave; ``held_out`` says whether the document was no example there.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predicted(counts, how), SCHEMA)


def predicted_languages(docs: DataFrame, how: Mixture = Mixture()) -> DataFrame:
    """Learn from two thirds of the documents, by id, and predict all."""
    return languages(docs, learn(docs.where(~held_out(F.col("doc_id")))), how)
