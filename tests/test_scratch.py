"""Intermediate tables: where they go, and what is sent to tasks."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from costdocs.operators import classify, dedup
from costdocs.operators.flags import clean_cost, usage_hours
from costdocs.operators.joins import bounded_copy, weigh
from costdocs.operators.profile import numeric_profile, summary

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_a_setting_nothing_is_guessed(tmp_path):
    code = """
from pyspark.sql import SparkSession
from costdocs.sources.scratch import shared_folder
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
try:
    shared_folder(spark)
except ValueError as error:
    assert "spark.checkpoint.dir" in str(error)
else:
    raise SystemExit("a folder was guessed")
spark.stop()
from costdocs.plans import mart
from costdocs.session import local_session
spark = local_session("1", memory="1g")
mart.build_single_pass(spark.range(0).selectExpr(*[f"cast(NULL AS {t}) AS {c}" for c, t in __import__("costdocs.sources.cost", fromlist=["x"]).CUR_TYPES.items()]))["monthly_summary"].collect()
print("fine", shared_folder(spark))
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=200)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_bytes_are_counted_before_rows_are_fetched(spark):
    df = spark.createDataFrame([(1, "x" * 1000, [1.0, 2.0]), (2, None, None)], "a int, b string, c array<double>")
    assert weigh(df) == (2, 48 + 1000 + 16)
    assert bounded_copy(df, 2).count() == 2
    assert bounded_copy(df, 1) is None and bounded_copy(df, 9, 500) is None


def test_known_hashes_do_not_move_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("text_hash")).write.parquet(path)
    batch = spark.createDataFrame([("new", 1), (None, 2)], "text_hash string, n int").unionByName(spark.read.parquet(path).limit(1).withColumn("n", F.lit(3)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = dedup.drop_known(batch, spark.read.parquet(path))
        text = left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["n"] for r in left.collect()) == [1, 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The hint of the counted batch holds although the threshold forbids a broadcast.
    assert "BroadcastHashJoin [text_hash" in text


def test_a_triple_with_two_categories_does_not_multiply(spark):
    keys = classify.MAPPING_KEYS
    items = spark.createDataFrame([("u", "o", "p"), ("u", "o", "p"), ("x", "o", "p")], keys)
    mapping = spark.createDataFrame([("u", "o", "p", "A"), ("u", "o", "p", "B")], [*keys, "category"])
    assert sorted(r["llm_category"] for r in classify.apply_mapping(items, mapping).collect()) == ["B", "B", "Other"]


def test_prefixes_are_compared_within_a_query(spark):
    rows = spark.createDataFrame([(1, 2, "same"), (1, 1, "same"), (2, 1, "same"), (2, 2, "other")], "query_id long, rank int, text string")
    kept = dedup.dedup_by_prefix(rows, "text", ["rank"], keys=["query_id"]).collect()
    assert sorted((r["query_id"], r["rank"]) for r in kept) == [(1, 1), (2, 1), (2, 2)]


def test_amounts_that_are_no_number(spark):
    rows = spark.createDataFrame([("Hrs", float("nan")), ("Hrs", 2.0), ("Hrs", None)], "pricing_unit string, lineitem_usageamount double")
    assert rows.agg(F.sum(usage_hours())).first()[0] == 2.0
    odd = spark.createDataFrame([(float("nan"), 1), (3.0, 2), (None, 3)], "x float, y int")
    numbers = {r["column"]: (r["sum"], r["mean"], r["min"], r["max"]) for r in numeric_profile(odd).collect()}
    assert numbers == {"x": (3.0, 3.0, 3.0, 3.0), "y": (6.0, 2.0, 1.0, 3.0)}
    assert summary(odd)["numeric_summary"]["x"]["max"] == 3.0


@pytest.mark.parametrize("cost, number", [("1.25", 1.25), ("1e17", 1e17), ("Infinity", 0), ("-Infinity", 0), ("NaN", 0), ("n/a", 0), (None, 0), ("0.00000000004", 0)])
def test_costs(spark, cost, number):
    assert float(spark.createDataFrame([(cost,)], "c string").select(clean_cost(F.col("c"))).first()[0]) == number


def test_a_cost_that_does_not_fit_is_no_zero(spark):
    with pytest.raises(Exception, match="cost out of range: 1e18"):
        spark.createDataFrame([("1e18",)], "c string").select(clean_cost(F.col("c"))).collect()
