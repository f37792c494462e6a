"""A worker holds few texts, and what is made of them, at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costdocs.functions import batches, markup
from costdocs.functions.splitter import split_column, split_text

TEXTS = [None if i % 7 == 0 else f"<title>t{i}</title><h1>a{i}</h1>" + f"<a href='x{i}'>word {i}</a> " * (i % 5) for i in range(3 * batches.PIECE + 5)]


@pytest.mark.parametrize("udf", [markup.page_parts_udf, markup.page_facts_udf("text", "links"), markup.page_document_udf, markup.page_text_udf])
def test_pages_are_python_objects_a_few_at_a_time(udf):
    made = list(udf.func(iter([pa.array(TEXTS), pa.array(TEXTS[:3]), pa.array([], pa.string())])))
    assert max(len(piece) for piece in made) == batches.PIECE
    assert sum(len(piece) for piece in made) == len(TEXTS) + 3


def test_pieces_meet_their_rows(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    facts = rows.select("id", "text", markup.page_facts_udf("title", "links")("text").alias("facts"), split_column(F.col("text"), 40, 10).alias("parts"))
    found = facts.collect()
    assert len(found) == len(TEXTS)
    for r in found:
        expected = markup.Facts(("title", "links")).run(r["text"] or "").found()
        assert r["facts"].asDict(recursive=True) == expected and r["parts"] == split_text(r["text"], 40, 10)
