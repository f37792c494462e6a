import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.functions.text import (
    decode_entities,
    distinct_lines,
    first_filled,
    normalise_month,
    parse_accounts,
    title_case,
    truncate,
)
from costdocs.operators import classify, rollups
from costdocs.operators.flags import FLAGS, clean_cost, fact
from costdocs.operators.profile import numeric_profile, summary
from costdocs.plans import mart, scenarios
from costdocs.sources import contracts as contract_source
from costdocs.sources import cost as cost_source


def line_items(spark, *rows):
    """Line items from dicts; columns that are not given are null."""
    return spark.createDataFrame([tuple(r.get(c) for c in cost_source.CUR_COLUMNS) for r in rows], cost_source.CUR_SCHEMA)


def item(usage=None, operation=None, cost="1.5", **more):
    return {
        "billing_ym": "202508",
        "lineitem_usagetype": usage,
        "lineitem_operation": operation,
        "lineitem_unblendedcost": cost,
        "lineitem_blendedcost": cost,
        "lineitem_lineitemtype": "Usage",
        "product_productname": "Amazon SageMaker",
        **more,
    }


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "usage, operation, expected",
    [
        ("x-HOST:ml", None, {"is_endpoint"}),
        ("x-endpoint", None, {"is_endpoint"}),
        ("Studio-Notebook", None, {"is_studio", "is_notebook"}),
        ("notebk", None, {"is_notebook"}),
        (None, "CreateTrainingJob", {"is_training"}),
        ("SpotTrain", None, {"is_spot", "is_training"}),
        ("FeatureStore:Write", None, {"is_featurestore"}),
        ("FeatureStorage", None, {"is_storage"}),
        ("processing", None, {"is_processing"}),
        ("Data-Bytes-Out", None, {"is_data_transfer"}),
        ("DataTransfer-In", None, {"is_data_transfer"}),
        ("Host:VolumeUsage", None, {"is_endpoint", "is_storage"}),
        (None, None, set()),
    ],
)
def test_flags_overlap_and_ignore_case(spark, usage, operation, expected):
    row = fact(line_items(spark, item(usage, operation))).first()
    assert {f for f in FLAGS if row[f]} == expected
    assert all(row[f] is not None for f in FLAGS)


@pytest.mark.parametrize("unit, hours", [("Hrs", 2.0), ("hours", 2.0), ("1 Hour", 2.0), ("GB-Mo", None), (None, None)])
def test_usage_hours(spark, unit, hours):
    row = fact(line_items(spark, item(pricing_unit=unit, lineitem_usageamount=2.0))).first()
    assert row["usage_hours"] == hours


@pytest.mark.parametrize("raw, value", [("1.25", 1.25), ("1e2", 100.0), ("n/a", 0.0), ("", 0.0), (None, 0.0), ("NaN", 0.0), ("-3", -3.0)])
def test_cost_coercion(spark, raw, value):
    df = spark.createDataFrame([(raw,)], "c string")
    assert float(df.select(clean_cost(F.col("c"))).first()[0]) == value


def test_nan_double_cost_is_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (2.5,)], "c double")
    assert [float(r[0]) for r in df.select(clean_cost(F.col("c"))).collect()] == [0.0, 2.5]


def test_group_without_values_sums_to_zero(spark):
    df = line_items(spark, item("Host", pricing_unit="GB", lineitem_usageamount=4.0, cost=None))
    assert rows_of(rollups.summarise(fact(df), "agg_endpoint_hours")) == [(None, None, 0.0, 0.0)]


def test_null_keys_are_groups_but_months_are_not(spark):
    df = line_items(
        spark,
        item("Notebook", product_instancetype=None, pricing_unit="Hrs", lineitem_usageamount=3.0),
        item("Notebook", product_instancetype=None, pricing_unit="Hrs", lineitem_usageamount=1.0),
        item("Notebook", product_instancetype="ml.t3", billing_ym=None),
    )
    costs = fact(df)
    assert rows_of(rollups.summarise(costs, "agg_notebook_hours")) == [("ml.t3", 0.0, 1.5), (None, 4.0, 3.0)]
    assert rows_of(rollups.summarise(costs, "monthly_summary")) == [("202508", 3.0, 3.0)]


def test_empty_input_gives_empty_tables_with_columns(spark):
    tables = mart.build(line_items(spark))
    assert set(tables) == set(rollups.TABLES)
    assert all(df.count() == 0 for df in tables.values())
    assert tables["agg_endpoint_hours"].columns == ["resource_id", "instance_type", "hours", "cost"]
    assert tables["agg_spot_ratio"].columns == ["pricing_type", "cost"]
    assert tables["monthly_summary"].columns == ["billing_ym", "unblended_cost", "blended_cost"]
    assert {r["table"]: r["rows"] for r in rollups.row_counts(tables).collect()} == dict.fromkeys(rollups.TABLES, 0)


def test_single_pass_equals_one_table_at_a_time(spark, sf_dir):
    from costdocs.checks.cost import extracted

    items = extracted(spark, sf_dir)
    plain, single = mart.build(items), mart.build_single_pass(items)
    for name in rollups.ROLLUP:
        assert rows_of(plain[name]) == rows_of(single[name]), name


def test_extract_filters(spark):
    df = line_items(
        spark,
        item(lineitem_usageaccountid="001"),
        item(lineitem_usageaccountid="001", lineitem_lineitemtype="Tax"),
        item(lineitem_usageaccountid="001", product_productname="amazon sagemaker"),
        item(lineitem_usageaccountid="002"),
        item(lineitem_usageaccountid="001", billing_ym="202507"),
    )
    assert cost_source.extract(df, ["2025-08"], [" 001 ", ""]).count() == 1
    assert cost_source.extract(df).count() == 3
    assert cost_source.extract(df, limit=2).count() == 2
    assert cost_source.extract(df).columns == cost_source.CUR_COLUMNS


def test_csv_keeps_leading_zeros_and_reads_any_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'lineitem_unblendedcost,"lineitem_usageaccountid",billing_ym,lineitem_usageamount,extra\n'
        '"n/a","000000000012","202508",1.5,"say ""hi"", you"\n,000000000013,202509,bad,x\n'
    )
    df = cost_source.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [
        ("n/a", "000000000012", "202508", 1.5, 'say "hi", you'),
        (None, "000000000013", "202509", None, "x"),
    ]


def test_csv_filters_only_when_asked(spark, tmp_path):
    df = line_items(spark, item(lineitem_usageaccountid="001"), item(lineitem_lineitemtype="Tax"))
    path = str(tmp_path / "csv")
    df.write.csv(path, header=True, quoteAll=True)
    assert cost_source.read_csv(spark, path).count() == 2
    assert cost_source.read_csv(spark, path, apply_filters=True, months=["202508"], accounts=["001"]).count() == 1


def test_csv_sample_is_the_ordered_head(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a"), F.col("id").alias("b")).repartition(13)
    expected = [(i,) for i in range(1000)]
    assert [(r["a"],) for r in cost_source.csv_sample(df).collect()] == expected
    cost_source.write_csv_sample(df, str(tmp_path / "s"), 10)
    (part,) = (tmp_path / "s").glob("*.csv")
    assert part.read_text().splitlines()[:2] == ['"a","b"', '"0","0"']


def test_warehouse_predicates_split_and_cover():
    clauses = cost_source.month_predicates(["2025-08"])
    assert len(clauses) == 11 and all(c.startswith("billing_ym = '202508' AND") for c in clauses)
    assert cost_source.month_predicates(["202508"], account_digits=False) == ["billing_ym = '202508'"]
    with pytest.raises(ValueError):
        cost_source.month_predicates(["x' OR 1=1"])


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_read_plan_cuts_heavy_accounts(spark, parts):
    account = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("o'"), F.col("id") % 97, F.lit("\\x")))
    resource = F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("r"), F.col("id") % 1009))
    rows = spark.range(20_000).select(account.alias("lineitem_usageaccountid"), resource.alias("lineitem_resourceid"), (F.lit(202501) + F.col("id") % 2).cast("string").alias("billing_ym"), F.col("id").cast("string").alias("item"))
    rows, keys = rows.repartition(9).cache(), (*cost_source.READ_KEYS, "item")  # a resource holds a fifteenth
    cuts = cost_source.read_cuts(rows, parts, keys)
    clauses = cost_source.range_predicates(cuts, keys=keys)
    counts = [rows.where(c).count() for c in clauses]
    assert sum(counts) == 20_000 and max(counts) <= 2 * 20_000 / parts
    assert rows.where(" OR ".join(f"({c})" for c in clauses)).count() == 20_000
    by_month = cost_source.range_predicates(cuts, ["2025-01", "2025-02"], keys)
    assert len(by_month) == 2 * len(clauses) and sum(rows.where(c).count() for c in by_month[: len(clauses)]) == rows.where("billing_ym = '202501'").count()


def test_read_plan_of_nothing(spark):
    empty = spark.createDataFrame([], "lineitem_usageaccountid string, lineitem_resourceid string")
    assert cost_source.range_predicates(cost_source.read_cuts(empty, 5)) == ["1 = 1"]
    with pytest.raises(ValueError):
        cost_source.read_cuts(empty, 0)


@pytest.mark.parametrize(
    "usage, operation, category",
    [
        ("x", "InvokeEndpoint", "Endpoint"),
        ("Inference:ml", "Train", "Endpoint"),
        ("JUPYTER", None, "Notebook"),
        (None, "CreateModel", "Training"),
        ("Batch", None, "Processing"),
        ("x", "BatchTransform", "Processing"),
        (None, None, "Other"),
        ("Misc", "Other", "Other"),
    ],
)
def test_rule_category(spark, usage, operation, category):
    assert classify.categorise(line_items(spark, item(usage, operation))).first()["rule_category"] == category


@pytest.mark.parametrize("max_rows", [classify.MAX_LOOKUP_ROWS, 0])
def test_mapping_is_written_back_by_plain_equality(spark, max_rows):
    rows = [item("a", "b", lineitem_resourceid=str(i)) for i in range(20)] + [item(None, "b"), item("z", "b")]
    keys = ["lineitem_usagetype", "lineitem_operation", "product_productname"]
    mapping = spark.createDataFrame(
        [("a", "b", "Amazon SageMaker", "Endpoint"), (None, "b", "Amazon SageMaker", "Training")],
        ", ".join(f"{k} string" for k in keys) + ", category string",
    )
    out = classify.apply_mapping(line_items(spark, *rows).repartition(4), mapping, max_rows=max_rows)
    counts = {(r["lineitem_usagetype"], r["llm_category"]): r["n"] for r in out.groupBy("lineitem_usagetype", "llm_category").agg(F.count("*").alias("n")).collect()}
    assert counts == {("a", "Endpoint"): 20, (None, "Other"): 1, ("z", "Other"): 1}
    assert out.columns == [*cost_source.CUR_COLUMNS, "llm_category"]


def test_mapping_without_its_keys_falls_back_to_rules(spark):
    df = line_items(spark, item("Endpoint")).drop("product_productname")
    assert "rule_category" in classify.categorise(df, df).columns


@pytest.mark.parametrize("text, category", [('{"category": "Notebook"}', "Notebook"), ("{}", "Other"), ("no json", "Other"), (None, "Other")])
def test_category_answers(spark, text, category):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(classify.parse_category(F.col("t"))).first()[0] == category


def test_url_categories_in_order(spark):
    expected = {
        "https://x/Studio-classic.html": "studio",
        "https://x/rstudio.html": "studio",
        "https://x/nbi-lifecycle": "notebook",
        "https://x/training-notebook": "notebook",
        "https://x/your-training": "training",
        "https://x/inference": "inference",
        "https://x/autopilot": "autopilot",
        "https://x/feature-store": "feature_store",
        "https://x/model-monitor": "monitoring",
        "https://x/pipelines": "pipelines",
        "https://x/canvas": "canvas",
        "https://x/geospatial": "geospatial",
        "https://x/hyperpod": "hyperpod",
        "https://x/jupyter": "jupyter",
        "https://x/security": "security",
        "https://x/assets": "assets",
        "https://x/algorithms": "algorithms",
        "https://x/frameworks": "frameworks",
        "https://x/partner": "partner",
        "https://x/migrate": "migration",
        "https://x/feature_store": "other",
    }
    df = spark.createDataFrame([(u,) for u in expected] * 2, "url string")
    assert {r["url"]: r["category"] for r in classify.with_category(df).collect()} == expected
    assert {r["category"]: r["n"] for r in classify.category_counts(df).collect()}["studio"] == 2


CONTRACTS = """{"contracts": {
  "one": {"name": "One", "accounts": ["001", "002"], "tags": ["a"]},
  "none": {"name": "None", "accounts": []},
  "bare": {"name": "Bare"}},
 "default_contract": "one"}"""


@pytest.fixture
def contracts(spark, tmp_path):
    (tmp_path / "contracts.json").write_text(CONTRACTS)
    return contract_source.read_contracts(spark, str(tmp_path / "contracts.json"))


def test_contracts(spark, contracts):
    summaries = {r["contract_id"]: r for r in contract_source.contract_summary(contracts).collect()}
    assert summaries["one"]["account_count"] == 2 and summaries["one"]["description"] == ""
    assert summaries["bare"]["account_count"] == 0 and summaries["bare"]["accounts"] == []
    asked = spark.createDataFrame([("one",), ("none",), ("bare",), ("other",)], "contract_id string")
    valid = {r["contract_id"]: r["valid"] for r in contract_source.contract_validity(contracts, asked).collect()}
    assert valid == {"one": True, "none": False, "bare": False, "other": False}
    assert {r["contract_id"] for r in contracts.where("is_default").collect()} == {"one"}


def test_missing_contract_file_is_no_contracts(spark, tmp_path):
    assert contract_source.read_contracts(spark, str(tmp_path / "nothing.json")).count() == 0


@pytest.mark.parametrize("max_rows", [100, 0])
def test_line_items_of_a_contract(spark, contracts, max_rows):
    df = line_items(spark, *[item(lineitem_usageaccountid=a) for a in ("001", "001", "002", "003", None)])
    accounts = contract_source.contract_accounts(contracts)
    kept = contract_source.keep_accounts(df, accounts, max_rows)
    assert sorted(r["lineitem_usageaccountid"] for r in kept.collect()) == ["001", "001", "002"]
    assert kept.columns == df.columns


def test_choice_of_line_items(spark, contracts):
    df = line_items(spark, *[item(lineitem_usageaccountid=a) for a in ("001", "003")])
    assert contract_source.choose_line_items(df, contracts).count() == 1
    assert contract_source.choose_line_items(df, account_ids=["003 "]).count() == 1
    for wrong in ({"contract_id": "one", "account_ids": ["1"]}, {"contract_id": "none"}, {"contract_id": "other"}):
        with pytest.raises(ValueError):
            contract_source.choose_line_items(df, contracts, **wrong)


def test_text_helpers(spark):
    assert one(spark, normalise_month(F.lit("2025-08"))) == "202508"
    assert one(spark, parse_accounts(F.lit(" 1, ,2,\t3 ,"))) == ["1", "2", "3"]
    assert one(spark, first_filled(F.lit(None), F.lit(""), F.lit("b"))) == "b"
    assert one(spark, decode_entities(F.lit("a&nbsp;&amp;lt;b"))) == "a <b"
    assert one(spark, distinct_lines(F.lit(" b \n\na\r\nb\n c"))) == "b\na\nc"
    assert one(spark, title_case(F.lit("how-it_works"))) == "How It Works"
    assert one(spark, truncate(F.lit("x" * 11), 10, "…")) == "x" * 10 + "…"
    assert one(spark, truncate(F.lit("x" * 10), 10, "…")) == "x" * 10


def test_profile(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (3, None, "b")], "n int, x double, s string")
    out = {r["column"]: tuple(r)[1:] for r in numeric_profile(df).collect()}
    assert out == {"n": (4.0, 2.0, 1.0, 3.0), "x": (2.0, 2.0, 2.0, 2.0)}
    assert summary(df)["numeric_summary"]["n"] == {"sum": 4.0, "mean": 2.0, "min": 1.0, "max": 3.0}
    empty = summary(df.limit(0))
    assert (empty["row_count"], empty["column_count"]) == (0, 3)
    assert empty["numeric_summary"]["x"] == {"sum": 0.0, "mean": 0.0, "min": 0.0, "max": 0.0}
    assert numeric_profile(df.select("s")).count() == 0
    large = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "n long")
    assert numeric_profile(large).first()["sum"] == pytest.approx(2.0**64)


def test_trend_and_spikes(spark):
    rows = [("202501", 10.0, 0.0), ("202502", 10.0, 0.0), ("202503", 10.0, 0.0), ("202504", 40.0, 0.0)]
    monthly = spark.createDataFrame(rows, "billing_ym string, unblended_cost double, blended_cost double")
    out = {r["billing_ym"]: r for r in scenarios.trend(monthly, 2.0).collect()}
    assert out["202501"]["change"] is None and not out["202501"]["is_spike"]
    assert out["202504"]["change"] == 30.0 and out["202504"]["mean_before"] == 10.0 and out["202504"]["is_spike"]


def test_tags_and_shares(spark):
    df = fact(line_items(spark, item(lineitem_usageaccountid="1", usertag0=" ", usertag3="x"), item(lineitem_usageaccountid="1")))
    row = scenarios.tag_missing_rate(df).first()
    assert (row["line_items"], row["untagged_rate"], row["usertag0_missing"], row["usertag3_missing"]) == (2, 0.5, 1.0, 0.5)
    shares = scenarios.spot_share(spark.createDataFrame([("Spot", 1.0), ("OnDemand", 3.0)], "pricing_type string, cost double"))
    assert {r["pricing_type"]: r["share"] for r in shares.collect()} == {"Spot": 0.25, "OnDemand": 0.75}


def test_schema_has_the_fixed_columns():
    assert len(cost_source.CUR_COLUMNS) == 29
    assert cost_source.CUR_SCHEMA["billing_ym"].dataType == T.StringType()
