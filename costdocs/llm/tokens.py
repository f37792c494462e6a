"""Token ids of whole texts with a public tokenizer, every distinct piece encoded once per worker.

A text is cut before single spaces, where none of the supported tokenizers joins what it cuts, so
the ids of the pieces, one after the other, are the ids of the text. New pieces are handed to the
tokenizer many at a time. Where the tokenizer drops white space, they are first cut again between
letters and signs. What is outside the plain cases is encoded as it stands. The string of a special
token has the token's id wherever it stands, as in the library; what is between is texts of their own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np

from costdocs.llm.common import ranges, worker_cache

MEMO_PIECES = 700_000  # pieces kept per Python worker
MEMO_IDS = 8_000_000  # and their ids
WINDOW = 1 << 20  # characters of a very long text that are cut at a time

_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af"  # but for the one whose small form is two characters
_SIGNS = r".,;:!?|#$%&*()\-"
_PARTS = re.compile(f"[{_LETTERS}]+|[{_SIGNS}]+")
_PLAIN = re.compile(f"[{_LETTERS}{_SIGNS}]+")
_RUN = re.compile(f"[{_LETTERS}]+")
_UNSAFE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_NOT_LATIN = re.compile("[^\\x00-\u02ff]")
_SEPARATORS = re.compile("[\x1c-\x1f]")


class _Table(dict):
    """Strings, their numbers in order of first use, and the ids of each."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        super().__init__()
        self.encode, self.waiting = encode, []
        self.lengths, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, text: str) -> int:
        number = self[text] = len(self)
        self.waiting.append(text)
        return number

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per string, all ids) of numbered strings; new ones are encoded first."""
        if self.waiting:
            waiting, self.waiting = self.waiting, []
            lengths, flat = self.encode(waiting)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
        lengths = self.lengths[codes]
        return lengths, self.flat[ranges(lengths, self.starts[codes])]


def _grouped(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of ``lengths`` over runs of ``counts`` values."""
    return np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)], prepend=0)


class Encoder:
    """Encodes texts like the tokenizer itself, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {token.content: number for number, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.tokenizer.encode_special_tokens = True  # what is left to it holds no such string
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.keeps_spaces = self._each(["a b"])[0] != self._each(["a  b"])[0]
        names = self.tokenizer.get_vocab()
        mark = (lambda t: t.startswith("\u0120")) if self.keeps_spaces else (lambda t: t.endswith("</w>"))
        self.marked = np.zeros(max(names.values()) + 1, bool)
        self.marked[[i for t, i in names.items() if mark(t)]] = True
        self._forget()

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.parts = _Table(self._encode_parts)
        self.pieces = _Table(self._encode_spaced if self.keeps_spaces else self._encode_pieces)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, flat = [], []
        for at in range(0, len(texts), 20_000):
            found = self._each(texts[at : at + 20_000])
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter((i for ids in found for i in ids), np.uint32))
        return np.concatenate(lengths), np.concatenate(flat)

    def _joined(self, texts: list[str], glue: str) -> tuple[np.ndarray, np.ndarray]:
        """Texts that are told apart by their first, or last, ids, as one text."""
        ids = np.array(self._each([glue + glue.join(texts)])[0], np.uint32)
        at = np.flatnonzero(self.marked[ids])
        if len(at) != len(texts):
            return self._one_by_one([glue + t for t in texts])
        return np.diff(at, append=len(ids)) if self.keeps_spaces else np.diff(at, prepend=-1), ids

    def _in_two_ways(self, texts: list[str], joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``joint`` texts, with a space before each, as one; the others on their own."""
        lengths, starts, flat = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        for group, encode in ((np.flatnonzero(joint), lambda t: self._joined(t, " ")), (np.flatnonzero(~joint), self._one_by_one)):
            for at in range(0, len(group), 100_000):
                some = group[at : at + 100_000]
                lengths[some], ids = encode([texts[i] for i in some.tolist()])
                starts[some] = len(flat) + np.cumsum(lengths[some]) - lengths[some]
                flat = np.concatenate([flat, ids])
        return lengths, flat[ranges(lengths, starts)]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._in_two_ways(parts, np.fromiter((_RUN.fullmatch(p) is not None for p in parts), bool, len(parts)))

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lookup, counts, codes = self.parts.__getitem__, np.ones(len(pieces), np.int64), []
        for i, piece in enumerate(pieces):
            if _PLAIN.fullmatch(piece) is None:
                codes.append(lookup(piece))
                continue
            found = _PARTS.findall(piece)
            counts[i] = len(found)
            codes.extend(map(lookup, found))
        lengths, ids = self.parts.ids(np.array(codes, np.int64))
        return _grouped(counts, lengths), ids

    def _encode_spaced(self, pieces: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces after a space; one that begins a text is in bytes."""
        joint = np.fromiter((type(p) is str and p != "" and " " not in p and not p[-1].isspace() for p in pieces), bool, len(pieces))
        texts = [p if j else (p.decode() if type(p) is bytes else " " + p) for p, j in zip(pieces, joint.tolist())]
        return self._in_two_ways(texts, joint)

    def _windows(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * WINDOW:
            cut = text.rfind(" ", at + 1, at + WINDOW)
            while cut > at and text[cut - 1].isspace():
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def _pieces_of(self, window: str) -> list[str | bytes]:
        if not self.keeps_spaces:
            # White space is dropped, and letters below U+0300 are folded to lower case one by one.
            if _NOT_LATIN.search(window) is None:
                window = window.lower()
            return window.split(" ") if _SEPARATORS.search(window) else window.split()
        if _UNSAFE.search(window) is None:
            pieces = window.split(" ")
        else:
            pieces = _CUT.split(window)
            pieces[1:] = [piece[1:] for piece in pieces[1:]]
        pieces[0] = pieces[0].encode()
        return pieces

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids in order); a null text has none."""
        if not any(text and any(s in text for s in self.special) for text in texts):
            return self._encode_plain(texts)
        parts = [self.at_special.split(text or "") if self.special else [text] for text in texts]
        lengths, ids = self._encode_plain([p for part in parts for p in part[::2]])
        # A token comes after every plain part but the last of its text.
        follows = np.concatenate([np.arange(len(part[::2])) < len(part) // 2 for part in parts])
        tokens = np.array([self.special[p] for part in parts for p in part[1::2]], np.uint32)
        ids = np.insert(ids, np.cumsum(lengths)[follows], tokens)
        return _grouped(np.array([len(part[::2]) for part in parts]), lengths + follows), ids

    def _encode_plain(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > MEMO_PIECES or len(self.pieces.flat) > MEMO_IDS:
            self._forget()
        lookup = self.pieces.__getitem__
        counts, codes = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
        for i, text in enumerate(texts):
            for window in self._windows(text or ""):
                codes.append(np.fromiter(map(lookup, self._pieces_of(window)), np.int64))
                counts[i] += len(codes[-1])
        lengths, ids = self.pieces.ids(np.concatenate(codes))
        return _grouped(counts, lengths), ids


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    cache = worker_cache()
    key = ("encoder", path)
    if key not in cache:
        cache[key] = Encoder(path)
    return cache[key]


def with_end(lengths: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with an end id after each."""
    return lengths + 1, np.insert(ids, np.cumsum(lengths), np.uint32(end))
