import random

import pytest
from pyspark.sql import types as T

# Names that the operators use for columns of their own.
CLASHING = ["size", "start", "length", "part", "fp", "root", "cell", "chunk", "key", "block", "draws", "shard", "target", "grade", "text_hash", "n"]


def docs_schema():
    known = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in known + [(c, T.StringType()) for c in CLASHING]])


def as_docs(spark, rows):
    """Documents from (doc_id, text, source), with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", s, None, *CLASHING) for i, t, s in rows], docs_schema())


MESSY = [
    (None, None, None),
    (None, "a b c d e f", "x"),
    (1, None, "x"),
    (2, "", "x"),
    (3, " \n\t ", None),
    (4, "Word, word. wordä İΣ <|endoftext|> it's", "y"),
    (5, "same words here and there", "y"),
    (5, "same words here and there", "y"),
    (6, "same words here and there", "z"),
    (7, " ".join(random.Random(1).choices(["the", "of", "Anger,", "ẍ", "12", "||"], k=9000)), "z"),
    (8, "x" * 5000, "\U0001f642"),
    (-9, "one", "￮"),
]


@pytest.fixture(scope="session")
def messy(spark):
    return as_docs(spark, MESSY)


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_docs(spark, [])
