"""Line items are moved once per step, with few columns."""

from costdocs.checks.fixtures import cost_table
from costdocs.plans import mart
from tests.test_cost import item, line_items
from tests.test_plans import plan


def test_line_items_are_moved_before_columns_are_made_of_them(spark, tmp_path, monkeypatch):
    given, made = [], mart.fact
    monkeypatch.setattr(mart, "fact", lambda df: given.append(df) or made(df))
    mart.write_mart(spark, line_items(spark, item("Host", billing_ym="202507"), item("Studio", billing_ym=None)), str(tmp_path))
    assert "RebalancePartitions" in given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["mart_month"], r["rows"]) for r in mart.manifest_counts(mart.read_manifest(spark, str(tmp_path))).where("table = 'fact_sagemaker_costs'").collect()} == {("202507", 1), (None, 1)}


def test_line_items_are_not_moved_to_customers(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(cost_table(spark, sf_dir).select("*"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    (at,) = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(o_custkey" in line]
    below = []
    for line in lines[at + 1 :]:
        if depth(line) <= depth(lines[at]):
            break
        below.append(line)
    assert below and "l_orderkey" not in "".join(below)
