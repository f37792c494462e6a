"""Recursive character splitting of one text into overlapping chunks.

The rule, as publicly described: take the first separator of the list that the text
contains, cut there (each separator stays at the head of the piece that follows it), cut
pieces that are still too long with the remaining separators, and pack neighbouring pieces
greedily up to the size, carrying at most ``overlap`` characters of tail into the next chunk.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.functions.batches import by_pieces
from costdocs.functions.text import strip_space

SEPARATORS = ("\n\n", "\n", " ", "")

CHUNKS_TYPE = T.ArrayType(T.StringType())


def _cut(text: str, separator: str) -> list[str]:
    if separator == "":
        return list(text)
    head, *tail = text.split(separator)
    pieces = [head, *(separator + t for t in tail)]
    return [p for p in pieces if p]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    window: deque[str] = deque()
    total = 0
    for piece in pieces:
        if window and total + len(piece) > size:
            yield "".join(window)
            while window and (total > overlap or total + len(piece) > size):
                total -= len(window.popleft())
        window.append(piece)
        total += len(piece)
    if window:
        yield "".join(window)


def _split(text: str, size: int, overlap: int, separators: Sequence[str]) -> Iterator[str]:
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    run: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            run.append(piece)
            continue
        yield from _pack(run, size, overlap)
        run = []
        if finer:
            yield from _split(piece, size, overlap, finer)
        else:
            yield piece
    yield from _pack(run, size, overlap)


def split_text(
    text: str | None, size: int = 1200, overlap: int = 120, separators: Sequence[str] = SEPARATORS
) -> list[str] | None:
    """Chunks of a text, stripped; blank chunks are left out."""
    if text is None:
        return None
    if overlap > size:
        raise ValueError("overlap must not be larger than size")
    stripped = (chunk.strip() for chunk in _split(text, size, overlap, separators))
    return [chunk for chunk in stripped if chunk]


def split_column(c: Column, size: int = 1200, overlap: int = 120, separators: Sequence[str] = SEPARATORS) -> Column:
    run = by_pieces(lambda t: split_text(t, size, overlap, separators), CHUNKS_TYPE)
    # Otherwise the filter that goes with explode would run the function a second time.
    return run.asNondeterministic()(c)


def step_column(c: Column, size: int = 1200, overlap: int = 120) -> Column:
    """A text cut into pieces of ``size - overlap`` characters, in one walk."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    return F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))


def window_column(steps: Column, length: Column, size: int = 1200, overlap: int = 120) -> Column:
    """Fixed windows of ``size`` characters every ``size - overlap``, JVM-side, in linear time.

    Equal to :func:`split_column` with the empty separator only. ``steps`` is a column holding
    :func:`step_column`; a window is one step and the head of the steps after it.
    """
    step = size - overlap
    windows = steps
    for k in range(1, -(-overlap // step) + 1):
        windows = F.zip_with(
            windows,
            F.slice(steps, F.lit(k + 1), F.size(steps)),
            lambda head, tail: F.concat(head, F.coalesce(tail, F.lit(""))),
        )
    count = F.greatest(F.lit(1), F.ceil((length - F.lit(overlap)) / F.lit(step)).cast("int"))
    return F.transform(F.slice(windows, F.lit(1), count), lambda x: strip_space(F.left(x, F.lit(size))))
