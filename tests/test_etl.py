import pytest

from costdocs.operators.classify import distinct_keys
from costdocs.plans import etl, mart
from costdocs.sources.contracts import parse_contracts
from costdocs.sources.scan import read_table
from pyspark.sql import functions as F
from tests.test_cost import item, line_items


def cost(spark):
    return line_items(
        spark,
        item("Endpoint", lineitem_usageaccountid="001"),
        item("Endpoint", lineitem_usageaccountid="002"),
        item("Notebook", lineitem_usageaccountid="001", billing_ym="202507"),
        item("Notebook", lineitem_usageaccountid="001", lineitem_lineitemtype="Tax"),
    )


def test_month_of_an_account_list(spark, tmp_path):
    base = str(tmp_path)
    out = etl.run_month(spark, base, "2025-08", cost(spark), account_ids=["001"], categories=True)
    assert out["billing_ym"] == "202508" and out["raw_rows"] == 1
    assert out["row_counts"]["fact_sagemaker_costs"] == 1 and out["row_counts"]["agg_notebook_hours"] == 0
    assert out["files"]["monthly_summary"] >= 0 and out["total_size_mb"] > 0
    fact = mart.read_mart(spark, base)["fact_sagemaker_costs"].first()
    assert (fact["rule_category"], fact["llm_category"]) == ("Endpoint", None)
    files = mart.read_manifest_files(spark, base).where("table = 'fact_sagemaker_costs'").collect()
    assert files and all(f["size_bytes"] > 0 and f["modified_at"] for f in files)


def test_month_of_the_default_contract_with_a_mapping(spark, tmp_path):
    text = spark.createDataFrame([('{"contracts": {"c": {"accounts": ["002"]}}, "default_contract": "c"}',)], "value string")
    items = cost(spark).withColumn("lineitem_operation", F.lit("op"))
    mapping = distinct_keys(items).withColumn("category", F.lit("Mine"))
    out = etl.run_month(spark, str(tmp_path), "202508", items, contracts=parse_contracts(text), categories=True, mapping=mapping)
    assert out["row_counts"]["fact_sagemaker_costs"] == 1
    fact = mart.read_mart(spark, str(tmp_path))["fact_sagemaker_costs"].first()
    assert (fact["lineitem_usageaccountid"], fact["llm_category"]) == ("002", "Mine")


def test_csv_is_taken_without_filters(spark, tmp_path):
    cost(spark).write.csv(str(tmp_path / "in"), header=True, quoteAll=True)
    out = etl.run_month(spark, str(tmp_path / "out"), "202508", csv_path=str(tmp_path / "in"))
    assert out["raw_rows"] == 4 and out["row_counts"]["fact_sagemaker_costs"] == 4
    assert out["row_counts"]["monthly_summary"] == 2
    with pytest.raises(ValueError):
        etl.run_month(spark, str(tmp_path / "out"), "202508")


def test_small_tables_are_spread_over_the_cores(spark, sf_dir):
    plain = read_table(spark, f"{sf_dir}/lineitem.parquet")
    spread = read_table(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey")
    cores = spark.sparkContext.defaultParallelism
    assert plain.rdd.getNumPartitions() < cores == spread.rdd.getNumPartitions()
    assert plain.count() == spread.count()
