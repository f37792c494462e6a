"""Python functions of one text, run over Arrow batches a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PIECE = 64  # rows whose texts and results a worker has as Python objects at a time


def by_pieces(each: Callable[[str | None], Any], kind: T.DataType) -> Callable:
    """A column function that calls ``each`` for every text; only the batch itself is in the worker as a whole.

    A batch holds ten thousand texts by default, and what is made of them may be many times as large.
    """
    made = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), PIECE):
                yield pa.array([each(text) for text in batch.slice(at, PIECE).to_pylist()], type=made)

    return run
