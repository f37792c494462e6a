"""What a CSV delivery takes on disk."""

import os

from costdocs.checks import cost as cost_checks


def test_csv_bills_are_stored_compressed(spark, sf_dir):
    path = cost_checks._csv_path(spark, sf_dir).removeprefix("file:")
    data = [f for f in os.listdir(path) if f.startswith("part-")]
    assert data and all(f.endswith(".csv.gz") for f in data)
