"""New chunks are found with one move of their texts."""

import pytest

from costdocs.operators import dedup
from tests.test_plans import plan


@pytest.mark.parametrize("large", [False, True])
def test_unknown_rows_are_found_by_one_merging(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(dedup, "bounded_copy", lambda df: None)
    batch = spark.createDataFrame([("b", 2, "x"), ("b", 1, "y"), ("a", 1, "z"), ("c", 5, None), (None, 1, "n"), (None, 0, "m"), ("c", 5, None)], "text_hash string, place int, text string")
    store = spark.createDataFrame([("a",), ("q",), (None,), ("a",)], "text_hash string")
    found = dedup.dedup_unknown(batch, store, ["place"])
    text = plan(found)
    expected = dedup.drop_known(dedup.dedup_by_hash(batch, ["place"]), store)
    assert found.columns == batch.columns and sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)
    assert {(r["text_hash"], r["place"]) for r in found.collect()} == {("b", 1), ("c", 5), (None, 0)}
    if large:
        assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text and "Generate" not in text
