"""Every registered query against its DuckDB twin on the smallest tables."""

import decimal
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from costdocs.sources.scratch import shared_folder

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 9)
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["resource_id", "instance_type", "hours", "cost"] and df.count() > 0


def test_scratch_is_the_folder_the_session_names(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir") == shared_folder(spark)
