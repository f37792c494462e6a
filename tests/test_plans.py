"""What the plans must look like to hold at a thousand times the data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from costdocs.operators import rollups, search
from costdocs.operators.flags import fact
from costdocs.plans import mart
from costdocs.sources import cost as cost_source
from tests.test_cost import item, line_items


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake") / "cost")
    rows = [item("Host", billing_ym=m, lineitem_usageaccountid=a) for m in ("202507", "202508") for a in ("001", "002")]
    line_items(spark, *rows).write.partitionBy("billing_ym").parquet(path)
    return spark.read.schema(cost_source.CUR_SCHEMA).parquet(path)


def test_extraction_filters_reach_the_scan(lake):
    text = plan(cost_source.extract(lake, ["2025-08"], ["001"]))
    assert "PartitionFilters: [isnotnull(billing_ym" in text
    pushed = text.split("PushedFilters: [")[1].split("], ReadSchema")[0]
    assert "EqualTo(lineitem_lineitemtype,Usage)" in pushed
    assert "StringContains(product_productname,SageMaker)" in pushed
    assert "EqualTo(lineitem_usageaccountid,001)" in pushed
    assert "Exchange" not in text


def test_a_summary_reads_only_its_columns(lake):
    text = plan(rollups.summarise(fact(cost_source.extract(lake)), "agg_featurestore_cost"))
    columns = text.split("ReadSchema: struct<")[1].split(">")[0]
    names = {c.split(":")[0].strip() for c in columns.split(",")}
    assert names == {"lineitem_unblendedcost", "lineitem_usagetype", "lineitem_lineitemtype", "product_productname"}
    assert "partial_sum" in text and text.count("Exchange") == 1


def test_all_summaries_need_one_scan_and_one_shuffle(lake):
    text = plan(rollups.summarise_all(fact(lake)))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "partial_sum" in text


def test_stored_month_is_pruned(spark, lake, tmp_path):
    base = str(tmp_path)
    mart.write_mart(spark, lake, base)
    text = plan(mart.read_table(spark, base, "monthly_summary", "202507"))
    assert "PartitionFilters: [isnotnull(mart_month" in text


def test_search_drops_hits_before_the_shuffle_and_moves_no_texts(spark):
    corpus = spark.createDataFrame([(i, [1.0, float(i)], f"t{i}") for i in range(9)], "vec_id long, embedding array<double>, text string")
    text = plan(search.retrieve(corpus, corpus.select(F.col("vec_id").alias("query_id"), "embedding"), corpus))
    assert "WindowGroupLimit" in text and "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    before_shuffle = text.split("WindowGroupLimit")[-1]
    assert "Partial" in before_shuffle and "MapInArrow" in before_shuffle


WRITTEN_FIRST = {"a02", "a03", "a05", "a06", "a07", "a08", "a10", "a13", "a14", "a15", "i14", "k03"}


@pytest.mark.parametrize("name", [n for n in entry.queries() if n[:3] not in WRITTEN_FIRST])
def test_no_query_joins_everything_with_everything(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


PYTHON_NODES = {
    "a12_page_load": 1,
    "c04_keyword_dictionary": 1,
    "i05_links": 1,
    "i06_topics": 1,
    "i08_page_structure": 1,
    "i10_sections": 1,
    "i11_recursive_chunk_rows": 1,
    "i13_chunk_metadata": 2,
}


@pytest.mark.parametrize("name", PYTHON_NODES)
def test_texts_pass_through_python_once_per_step(spark, sf_dir, name):
    assert plan(entry.queries()[name](spark, sf_dir)).count("ArrowEvalPython") == PYTHON_NODES[name]


def test_a_month_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60000).select(
        F.when(F.col("id") % 20 == 0, F.concat(F.lit("20250"), (F.col("id") % 7 + 1).cast("string"))).otherwise("202508").alias("billing_ym"),
        F.sha2(F.col("id").cast("string"), 256).alias("lineitem_resourceid"),
    )
    missing = {f.name: F.lit(None).cast(f.dataType) for f in cost_source.CUR_SCHEMA if f.name not in rows.columns}
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "256k")
        mart.write_mart(spark, rows.withColumns(missing), str(tmp_path))
    finally:
        spark.conf.set(size, before)
    files = mart.stored_files(spark, str(tmp_path)).where("table = 'fact_sagemaker_costs'")
    per_month = {r["mart_month"]: r["n"] for r in files.groupBy("mart_month").agg(F.count("*").alias("n")).collect()}
    assert per_month.pop("202508") > 3
    assert set(per_month.values()) == {1}


def test_large_lookups_are_salted(spark):
    from costdocs.operators.joins import lookup_join

    big = spark.range(1000).select(F.when(F.col("id") < 999, "hot").otherwise("cold").alias("k"), "id").repartition(8)
    lookup = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(big, lookup, ["k"], "left", max_rows=1)
        text = plan(joined)
        assert "SortMergeJoin [k" in text and "_salt" in text.split("SortMergeJoin")[1].split("]")[0]
        assert joined.where("v = 1").count() == 999 and joined.columns == ["k", "id", "v"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
