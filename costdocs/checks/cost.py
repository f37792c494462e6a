"""Registered queries over billing line items: reading, flags, summaries, mart, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.checks.fixtures import (
    CATEGORY_SQL,
    CONTRACT_SQL,
    contract_texts,
    cost_table,
    money,
    table,
    with_cost,
    with_odd_amounts,
)
from costdocs.checks.registry import register, written_once
from costdocs.functions.text import contains_any, normalise_month, parse_accounts
from costdocs.operators import classify, rollups
from costdocs.operators.flags import FLAGS, clean_cost, fact, flag, pricing_type, usage_hours
from costdocs.operators.guard import run_guarded
from costdocs.operators.profile import numeric_profile, result_size
from costdocs.plans import mart, scenarios
from costdocs.plans.ask import ask
from costdocs.sources import contracts as contract_source
from costdocs.sources import cost as cost_source

COLUMNS_SQL = ", ".join(cost_source.CUR_COLUMNS)
MONTHS_1995 = [f"1995-{m:02d}" for m in range(1, 13)]
MONTHS_SQL = ", ".join(f"'{m.replace('-', '')}'" for m in MONTHS_1995)


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_source.extract(cost_table(spark, sf_dir))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(extracted(spark, sf_dir))


def odd_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged line items some of whose amounts are missing or no number."""
    return fact(with_odd_amounts(extracted(spark, sf_dir)))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_source.parse_contracts(contract_texts(spark, sf_dir))


# ---- reading and filters -----------------------------------------------------------------

register(
    "a01_cost_read",
    lambda s, d: cost_source.extract(
        contract_source.choose_line_items(cost_table(s, d), contracts(s, d)), months=MONTHS_1995
    ),
    with_cost(
        f"SELECT {COLUMNS_SQL} FROM ext WHERE billing_ym IN ({MONTHS_SQL}) AND lineitem_usageaccountid IN"
        " (SELECT lpad(cast(c_custkey AS varchar), 12, '0') FROM customer WHERE c_custkey < 100)"
    ),
)


def _csv_path(spark: SparkSession, sf_dir: str) -> str:
    def write(path: str) -> None:
        cost_table(spark, sf_dir).write.csv(path, header=True, quoteAll=True, compression="gzip")  # as bills are delivered

    return written_once(spark, sf_dir, "cost-csv", write)


# A CSV file cannot tell an empty text from a missing one.
_CSV_SQL = ", ".join(
    f"nullif({c}, '') AS {c}" if c.startswith("usertag") else c for c in cost_source.CUR_COLUMNS
)
register(
    "a02_csv_read",
    lambda s, d: cost_source.read_csv(s, _csv_path(s, d)),
    with_cost(f"SELECT {_CSV_SQL} FROM cur"),
)


def raw_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_once(
        spark, sf_dir, "snapshot", lambda p: cost_source.write_snapshot(extracted(spark, sf_dir), p)
    )
    return cost_source.read_parquet(spark, path)


register("a03_raw_snapshot", raw_snapshot, with_cost(f"SELECT {COLUMNS_SQL} FROM ext"))
register(
    "a04_csv_sample",
    lambda s, d: cost_source.csv_sample(extracted(s, d)),
    with_cost(
        f"SELECT {COLUMNS_SQL} FROM ext ORDER BY "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in cost_source.CUR_COLUMNS)
        + " LIMIT 1000"
    ),
)


# ---- the stored mart ---------------------------------------------------------------------


def stored_mart(spark: SparkSession, sf_dir: str) -> str:
    return written_once(spark, sf_dir, "mart", lambda p: mart.write_mart(spark, extracted(spark, sf_dir), p))


SUMMARY_SQL = {
    "agg_endpoint_hours": ("is_endpoint", {"resource_id": "lineitem_resourceid", "instance_type": "product_instancetype"}, True),
    "agg_training_cost": ("is_training", {"account_id": "lineitem_usageaccountid", "instance_type": "product_instancetype"}, False),
    "agg_notebook_hours": ("is_notebook", {"instance_type": "product_instancetype"}, True),
    "agg_studio_hours": ("is_studio", {"instance_type": "product_instancetype"}, True),
    "agg_featurestore_cost": ("is_featurestore", {"usage_type": "lineitem_usagetype"}, False),
    "agg_processing_cost": ("is_processing", {"instance_type": "product_instancetype"}, False),
    "agg_datatransfer_cost": ("is_data_transfer", {"usage_type": "lineitem_usagetype"}, False),
    "agg_storage_cost": ("is_storage", {"usage_type": "lineitem_usagetype"}, False),
    "agg_spot_ratio": ("true", {"pricing_type": "CASE WHEN is_spot THEN 'Spot' ELSE 'OnDemand' END"}, False),
}


def summary_sql(name: str, month: bool = False) -> str:
    """SELECT text of one summary over ``fact``."""
    if name == "monthly_summary":
        extra = " billing_ym AS mart_month," if month else ""
        return (
            f"SELECT billing_ym,{extra} {money('lineitem_unblendedcost')} AS unblended_cost,"
            f" {money('lineitem_blendedcost')} AS blended_cost FROM fact WHERE billing_ym IS NOT NULL GROUP BY billing_ym"
        )
    condition, keys, hours = SUMMARY_SQL[name]
    outputs = [f"{e} AS {k}" for k, e in keys.items()]
    groups = list(keys.values())
    if month:
        outputs.append("billing_ym AS mart_month")
        groups.append("billing_ym")
    if hours:
        outputs.append("coalesce(sum(usage_hours), 0.0) AS hours")
    outputs.append(f"{money('lineitem_unblendedcost')} AS cost")
    return f"SELECT {', '.join(outputs)} FROM fact WHERE {condition} GROUP BY {', '.join(groups)}"


register(
    "a05_mart_write",
    lambda s, d: mart.read_table(s, stored_mart(s, d), "agg_endpoint_hours"),
    with_cost(summary_sql("agg_endpoint_hours", month=True)),
)
_ALL_MONTHS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", billing_ym AS mart_month, {keys[0]} AS key1, {keys[1] if len(keys) > 1 else 'cast(NULL AS varchar)'} AS key2,"
    f" {'coalesce(sum(usage_hours), 0.0)' if hours else '0.0'} AS hours, {money('lineitem_unblendedcost')} AS cost"
    f" FROM fact WHERE {condition} GROUP BY {', '.join([*keys, 'billing_ym'])}"
    for name, (condition, named, hours) in SUMMARY_SQL.items()
    for keys in [list(named.values())]
)


def stored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of nine stored summaries as one table; the tenth has its own query."""
    parts = []
    for name, (_, named, hours) in SUMMARY_SQL.items():
        keys = [F.col(k) for k in named] + [F.lit(None).cast("string")]
        parts.append(
            mart.read_table(spark, stored_mart(spark, sf_dir), name).select(
                F.lit(name).alias("table"), "mart_month", keys[0].alias("key1"), keys[1].alias("key2"),
                F.col("hours") if hours else F.lit(0.0).alias("hours"), "cost",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


register("a05_all_stored_summaries", stored_summaries, with_cost(_ALL_MONTHS_SQL))
register(
    "a05_stored_months",
    lambda s, d: mart.read_table(s, stored_mart(s, d), "monthly_summary"),
    with_cost(summary_sql("monthly_summary", month=True)),
)


def stored_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mart.read_table(spark, stored_mart(spark, sf_dir), rollups.FACT_TABLE).drop(*mart.CATEGORY_COLUMNS)
    return rows.withColumns({c: F.col(c).cast("double") for c in cost_source.COST_COLUMNS})


_STORED_COUNTS = " UNION ALL ".join(
    [
        "SELECT billing_ym AS mart_month, 'fact_sagemaker_costs' AS \"table\", count(*) AS rows FROM fact GROUP BY 1",
        *[
            f"SELECT m.billing_ym AS mart_month, '{name}' AS \"table\", count(t.mart_month) AS rows"
            f" FROM (SELECT DISTINCT billing_ym FROM fact) m LEFT JOIN ({summary_sql(name, month=True)}) t"
            " ON m.billing_ym = t.mart_month GROUP BY 1"
            for name in rollups.ROLLUP
        ],
    ]
)
register(
    "a06_mart_manifest",
    lambda s, d: mart.manifest_counts(mart.read_manifest(s, stored_mart(s, d))),
    with_cost(_STORED_COUNTS),
)


def latest_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stored_mart(spark, sf_dir)
    return mart.read_table(spark, base, "monthly_summary", mart.resolve_month(spark, base))


register(
    "a07_latest_month",
    latest_month,
    with_cost(
        f"SELECT * FROM ({summary_sql('monthly_summary')}) WHERE billing_ym = (SELECT max(billing_ym) FROM fact)"
    ),
)
register("a08_mart_sizes", lambda s, d: mart.mart_sizes(s, stored_mart(s, d)))
register(
    "a08_sized_tables",
    lambda s, d: mart.mart_sizes(s, stored_mart(s, d)).where("size_mb >= 0").select("mart_month", "table"),
    with_cost(f"SELECT mart_month, \"table\" FROM ({_STORED_COUNTS}) WHERE rows > 0"),
)


def total_of_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every month's total is that of its tables, but for their rounding."""
    base = stored_mart(spark, sf_dir)
    tables = mart.mart_sizes(spark, base).groupBy("mart_month").agg(F.sum("size_mb").alias("sum_mb"), F.count("*").alias("tables"))
    close = F.abs(F.col("total_size_mb") - F.col("sum_mb")) <= 0.005 * (F.col("tables") + 1) + 1e-9
    return mart.mart_total_size(spark, base).join(tables, "mart_month").select("mart_month", "tables", close.alias("adds_up"))


register(
    "a08_total_adds_up",
    total_of_sizes,
    with_cost(f"SELECT mart_month, count(*) AS tables, true AS adds_up FROM ({_STORED_COUNTS}) WHERE rows > 0 GROUP BY 1"),
)
register("a08_mart_total_size", lambda s, d: mart.mart_total_size(s, stored_mart(s, d)))


def mart_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart.catalog(mart.read_mart(spark, stored_mart(spark, sf_dir)))


_STORED_FACT = ", ".join(
    [*cost_source.CUR_COLUMNS, *FLAGS, "usage_hours", *[f"cast(NULL AS varchar) AS {c}" for c in mart.CATEGORY_COLUMNS]]
)
_DESCRIBED = " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", row_number() OVER () - 1 AS ordinal, column_name AS \"column\","
    f" replace(lower(column_type), 'varchar', 'string') AS type FROM (DESCRIBE {sql})"
    for name, sql in {
        rollups.FACT_TABLE: f"SELECT {_STORED_FACT} FROM fact",
        **{name: summary_sql(name) for name in rollups.ROLLUP},
    }.items()
)
register("a09_schema_catalog", mart_catalog, with_cost(_DESCRIBED))
register(
    "a10_months",
    lambda s, d: mart.months(s, stored_mart(s, d)),
    with_cost("SELECT DISTINCT billing_ym AS mart_month FROM fact WHERE billing_ym IS NOT NULL ORDER BY 1"),
)


def month_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = mart.month_info(spark, stored_mart(spark, sf_dir))
    return spark.createDataFrame(
        [(info["month"], info["file_count"], info["source_files"])], "month string, file_count int, source_files array<string>"
    ).select("month", "file_count", F.explode("source_files").alias("table"))


register(
    "a11_month_info",
    month_info,
    with_cost(
        "SELECT month, count(*) OVER () AS file_count, \"table\" FROM (SELECT mart_month AS month, \"table\", rows"
        f" FROM ({_STORED_COUNTS})) WHERE rows > 0 AND month = (SELECT max(billing_ym) FROM fact)"
    ),
)

# ---- contracts ---------------------------------------------------------------------------

register(
    "a17_contract_summary",
    lambda s, d: contract_source.contract_summary(contracts(s, d)).select(
        "contract_id", "name", "description", "account_count", F.concat_ws(",", "accounts").alias("accounts")
    ),
    f"WITH {CONTRACT_SQL} SELECT contract_id, name, '' AS description, len(accounts) AS account_count,"
    " coalesce(array_to_string(accounts, ','), '') AS accounts FROM contracts",
)


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(
        F.expr("concat('contract-', cast(o_orderkey div 100 AS string))").alias("contract_id")
    ).distinct()
    return contract_source.contract_validity(contracts(spark, sf_dir), asked)


register(
    "a18_contract_validity",
    validity,
    f"""WITH {CONTRACT_SQL}, asked AS (SELECT DISTINCT concat('contract-', cast(o_orderkey // 100 AS varchar)) AS contract_id FROM orders)
SELECT asked.contract_id AS contract_id, coalesce(len(accounts), 0) > 0 AS valid FROM asked LEFT JOIN contracts ON asked.contract_id = contracts.contract_id""",
)
register(
    "c01_account_semi_join",
    lambda s, d: contract_source.choose_line_items(cost_table(s, d), contracts(s, d), "contract-1")
    .groupBy("lineitem_usageaccountid")
    .agg(F.count("*").alias("n")),
    with_cost(
        "SELECT lineitem_usageaccountid, count(*) AS n FROM cur WHERE lineitem_usageaccountid IN"
        " (SELECT lpad(cast(c_custkey AS varchar), 12, '0') FROM customer WHERE c_custkey // 100 = 1) GROUP BY 1"
    ),
)


# ---- projection and filters --------------------------------------------------------------


def _count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


register(
    "b01_projection",
    lambda s, d: cost_table(s, d).select(*cost_source.CUR_COLUMNS),
    with_cost(f"SELECT {COLUMNS_SQL} FROM cur"),
)
register(
    "b02_month_filter",
    lambda s, d: _count_by(cost_source.month_filter(cost_table(s, d), MONTHS_1995), "billing_ym"),
    with_cost(f"SELECT billing_ym, count(*) AS n FROM cur WHERE billing_ym IN ({MONTHS_SQL}) GROUP BY 1"),
)
ACCOUNTS = ["000000000001", " 000000000002 ", "", "000000000003"]
register(
    "b03_account_filter",
    lambda s, d: _count_by(cost_source.account_filter(cost_table(s, d), ACCOUNTS), "lineitem_usageaccountid"),
    with_cost(
        "SELECT lineitem_usageaccountid, count(*) AS n FROM cur WHERE lineitem_usageaccountid IN"
        " ('000000000001', '000000000002', '000000000003') GROUP BY 1"
    ),
)
register(
    "b04_line_item_type_filter",
    lambda s, d: _count_by(cost_source.usage_filter(cost_table(s, d)), "lineitem_lineitemtype", "billing_ym"),
    with_cost(
        "SELECT lineitem_lineitemtype, billing_ym, count(*) AS n FROM cur WHERE lineitem_lineitemtype = 'Usage' GROUP BY 1, 2"
    ),
)
register(
    "b05_product_filter",
    lambda s, d: _count_by(cost_source.product_filter(cost_table(s, d)), "product_productname", "billing_ym"),
    with_cost(
        "SELECT product_productname, billing_ym, count(*) AS n FROM cur WHERE contains(product_productname, 'SageMaker') GROUP BY 1, 2"
    ),
)
register(
    "b06_month_normalise",
    lambda s, d: table(s, d, "orders")
    .select(normalise_month(F.date_format("o_orderdate", "yyyy-MM")).alias("billing_ym"))
    .groupBy("billing_ym")
    .agg(F.count("*").alias("n")),
    "SELECT strftime(o_orderdate, '%Y%m') AS billing_ym, count(*) AS n FROM orders GROUP BY 1",
)
_ACCOUNT_TEXT = "concat(' ', c_name, ' ,, ', cast(c_custkey AS {string}), ' , ')"
register(
    "b07_account_list_parse",
    lambda s, d: table(s, d, "customer")
    .select("c_custkey", parse_accounts(F.expr(_ACCOUNT_TEXT.format(string="string"))).alias("accounts"))
    .select("c_custkey", F.explode("accounts").alias("account_id")),
    "SELECT c_custkey, c_name AS account_id FROM customer UNION ALL SELECT c_custkey, cast(c_custkey AS varchar) FROM customer",
)
register(
    "b08_keyword_match",
    lambda s, d: extracted(s, d)
    .select("lineitem_usagetype", contains_any(F.col("lineitem_usagetype"), ["STUDIO"]).alias("hit"))
    .groupBy("lineitem_usagetype", "hit")
    .agg(F.count("*").alias("n")),
    with_cost(
        "SELECT lineitem_usagetype, coalesce(contains(lower(lineitem_usagetype), 'studio'), false) AS hit,"
        " count(*) AS n FROM ext GROUP BY 1, 2"
    ),
)
for _i, _name in enumerate(FLAGS, 9):
    register(
        f"b{_i:02d}_{_name}",
        lambda s, d, name=_name: extracted(s, d)
        .select("lineitem_usagetype", "lineitem_operation", flag(name).alias(name))
        .groupBy("lineitem_usagetype", "lineitem_operation", name)
        .agg(F.count("*").alias("n")),
        with_cost(
            f"SELECT lineitem_usagetype, lineitem_operation, {_name}, count(*) AS n FROM fact GROUP BY 1, 2, 3"
        ),
    )
register(
    "b18_usage_hours",
    lambda s, d: with_odd_amounts(extracted(s, d))
    .select("pricing_unit", "billing_ym", usage_hours().alias("usage_hours"))
    .groupBy("pricing_unit", "billing_ym")
    .agg(F.sum("usage_hours").alias("hours"), F.count("usage_hours").alias("n")),
    with_cost(
        "SELECT pricing_unit, billing_ym, sum(usage_hours) AS hours, count(usage_hours) AS n FROM fact GROUP BY 1, 2",
        odd=True,
    ),
)
register(
    "b19_cost_coercion",
    lambda s, d: extracted(s, d)
    .select(
        "lineitem_usageaccountid",
        F.col("lineitem_unblendedcost").alias("raw"),
        clean_cost(F.col("lineitem_unblendedcost")).alias("unblended"),
        clean_cost(F.col("lineitem_blendedcost")).alias("blended"),
    )
    .groupBy("lineitem_usageaccountid")
    .agg(
        rollups.total("unblended").alias("unblended"),
        rollups.total("blended").alias("blended"),
        F.count_if((F.col("raw") == "n/a") & (F.col("unblended") == 0)).alias("unreadable"),
    ),
    with_cost(
        f"SELECT lineitem_usageaccountid, {money('coalesce(try_cast(lineitem_unblendedcost AS decimal(28,10)), 0)')} AS unblended,"
        f" {money('coalesce(try_cast(lineitem_blendedcost AS decimal(28,10)), 0)')} AS blended,"
        " count(*) FILTER (WHERE lineitem_unblendedcost = 'n/a') AS unreadable FROM ext GROUP BY 1"
    ),
)
register(
    "b20_pricing_type",
    lambda s, d: facts(s, d)
    .select("lineitem_usagetype", pricing_type().alias("pricing_type"))
    .groupBy("lineitem_usagetype", "pricing_type")
    .agg(F.count("*").alias("n")),
    with_cost(
        "SELECT lineitem_usagetype, CASE WHEN is_spot THEN 'Spot' ELSE 'OnDemand' END AS pricing_type, count(*) AS n FROM fact GROUP BY 1, 2"
    ),
)
register(
    "b21_rule_category",
    lambda s, d: classify.categorise(extracted(s, d))
    .groupBy("lineitem_usagetype", "lineitem_operation", "rule_category")
    .agg(F.count("*").alias("n")),
    with_cost(
        f"SELECT lineitem_usagetype, lineitem_operation, {CATEGORY_SQL} AS rule_category, count(*) AS n FROM ext GROUP BY 1, 2, 3"
    ),
)


def outside_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outside answer per key triple, made from the triple, parsed as such answers are."""
    answer = F.when(
        F.col("lineitem_operation") == "BatchTransform", F.lit("no idea")
    ).otherwise(F.concat(F.lit('{"category": "'), F.coalesce(F.substring("lineitem_usagetype", 4, 4), F.lit("none")), F.lit('"}')))
    return classify.distinct_keys(extracted(spark, sf_dir)).withColumn("category", classify.parse_category(answer))


_MAPPED_SQL = (
    "CASE WHEN lineitem_operation = 'BatchTransform' OR lineitem_usagetype IS NULL THEN 'Other'"
    " ELSE substr(lineitem_usagetype, 4, 4) END"
)
register(
    "b22_external_category",
    lambda s, d: classify.categorise(extracted(s, d), outside_mapping(s, d))
    .groupBy("billing_ym", "llm_category")
    .agg(F.count("*").alias("n")),
    with_cost(f"SELECT billing_ym, {_MAPPED_SQL} AS llm_category, count(*) AS n FROM ext GROUP BY 1, 2"),
)
register(
    "c02_category_write_back",
    lambda s, d: classify.apply_mapping(extracted(s, d), outside_mapping(s, d))
    .groupBy(*classify.MAPPING_KEYS, "llm_category")
    .agg(F.count("*").alias("n")),
    with_cost(
        f"SELECT {', '.join(classify.MAPPING_KEYS)}, {_MAPPED_SQL} AS llm_category, count(*) AS n FROM ext GROUP BY 1, 2, 3, 4"
    ),
)

# ---- summaries ---------------------------------------------------------------------------

for _i, _name in enumerate(rollups.ROLLUP, 1):
    register(
        f"d{_i:02d}_{_name}",
        lambda s, d, name=_name: rollups.summarise(odd_facts(s, d), name),
        with_cost(summary_sql(_name), odd=True),
    )
register(
    "d11_row_counts",
    lambda s, d: rollups.row_counts(mart.build_single_pass(extracted(s, d))),
    with_cost(
        " UNION ALL ".join(
            ["SELECT 'fact_sagemaker_costs' AS \"table\", count(*) AS rows FROM fact"]
            + [f"SELECT '{n}' AS \"table\", count(*) AS rows FROM ({summary_sql(n)})" for n in rollups.ROLLUP]
        )
    ),
)


def _profiled(rows: DataFrame) -> DataFrame:
    """Some hours are no number; a profile leaves them out."""
    return rows.withColumn("hours", F.expr("CASE WHEN cost > 1000000 THEN cast('NaN' AS double) ELSE hours END"))


register(
    "d12_result_profile",
    lambda s, d: numeric_profile(_profiled(rollups.summarise(odd_facts(s, d), "agg_endpoint_hours"))).select(
        "column", *[F.round(c, 4).alias(c) for c in ("sum", "mean", "min", "max")]
    ),
    with_cost(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", round(sum({v}), 4) AS sum, round(avg({v}), 4) AS mean, round(min({v}), 4) AS min,"
            f" round(max({v}), 4) AS max FROM ({summary_sql('agg_endpoint_hours')})"
            for c, v in (("hours", "CASE WHEN cost <= 1000000 THEN hours END"), ("cost", "cost"))
        ),
        odd=True,
    ),
)
register(
    "d12_result_size",
    lambda s, d: result_size(rollups.summarise(facts(s, d), "agg_training_cost")),
    with_cost(f"SELECT count(*) AS row_count, 3 AS column_count FROM ({summary_sql('agg_training_cost')})"),
)
_FACT_SQL = ", ".join(
    [c for c in cost_source.CUR_COLUMNS if c not in cost_source.COST_COLUMNS]
    + [f"cast(cast({c} AS decimal(24,4)) AS double) AS {c}" for c in cost_source.COST_COLUMNS]
    + [*FLAGS, "usage_hours"]
)


def whole_mart_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = mart.build(extracted(spark, sf_dir))[rollups.FACT_TABLE]
    return costs.withColumns({c: F.col(c).cast("double") for c in cost_source.COST_COLUMNS})


register("d13_mart_fact", whole_mart_fact, with_cost(f"SELECT {_FACT_SQL} FROM fact"))
register("a05_stored_fact", stored_fact, with_cost(f"SELECT {_FACT_SQL}, billing_ym AS mart_month FROM fact"))


def _all_rows_sql() -> str:
    parts = []
    for name in rollups.ROLLUP:
        blended = "0.0"
        if name == "monthly_summary":
            condition, keys, hours, blended = "billing_ym IS NOT NULL", ["billing_ym"], False, money("lineitem_blendedcost")
        else:
            condition, named, hours = SUMMARY_SQL[name]
            keys = list(named.values())
        k1, k2 = (keys + ["NULL"])[:2]
        parts.append(
            f"SELECT '{name}' AS \"table\", {k1} AS key1, cast({k2} AS varchar) AS key2,"
            f" {'coalesce(sum(usage_hours), 0.0)' if hours else '0.0'} AS hours,"
            f" {money('lineitem_unblendedcost')} AS unblended, {blended} AS blended"
            f" FROM fact WHERE {condition} GROUP BY {', '.join(keys)}"
        )
    return " UNION ALL ".join(parts)


register(
    "d13_mart_single_pass",
    lambda s, d: rollups.summarise_all(facts(s, d)),
    with_cost(_all_rows_sql()),
)
register(
    "f01_debug_limit",
    lambda s, d: cost_source.extract(cost_table(s, d), limit=250).agg(F.count("*").alias("n")),
    with_cost("SELECT least(count(*), 250) AS n FROM ext"),
)
register(
    "f02_head_sample",
    lambda s, d: rollups.summarise(facts(s, d), "agg_training_cost")
    .orderBy(F.desc("cost"), F.asc_nulls_first("account_id"), F.asc_nulls_first("instance_type"))
    .limit(5),
    with_cost(
        f"SELECT * FROM ({summary_sql('agg_training_cost')}) ORDER BY cost DESC, account_id ASC NULLS FIRST, instance_type ASC NULLS FIRST LIMIT 5"
    ),
)
register(
    "g01_distinct_keys",
    lambda s, d: classify.distinct_keys(extracted(s, d)),
    with_cost(f"SELECT DISTINCT {', '.join(classify.MAPPING_KEYS)} FROM ext"),
)

# ---- SQL over the mart -------------------------------------------------------------------

GUARDED_SQL = (
    "SELECT instance_type, sum(hours) AS hours, sum(cost) AS cost "
    "FROM read_parquet('data/processed/latest/agg_endpoint_hours.parquet') "
    "WHERE instance_type IS NOT NULL GROUP BY instance_type;"
)


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_guarded(spark, GUARDED_SQL, mart.build(extracted(spark, sf_dir)))
    return out.select("instance_type", "hours", F.round("cost", 2).alias("cost"))


register(
    "l03_guarded_select",
    guarded,
    with_cost(
        f"SELECT instance_type, sum(hours) AS hours, round(sum(cost), 2) AS cost FROM ({summary_sql('agg_endpoint_hours')})"
        " WHERE instance_type IS NOT NULL GROUP BY 1"
    ),
)


NAMED_MONTH_SQL = (
    "SELECT usage_type, cost, '1995-03' AS month FROM read_parquet('data/processed/1995-03/agg_storage_cost.parquet')"
    " UNION ALL SELECT usage_type, cost, 'latest' FROM read_parquet('data/processed/latest/agg_storage_cost.parquet')"
)


def named_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text over the newest month and over one that it names."""
    base = stored_mart(spark, sf_dir)
    month = mart.resolve_month(spark, base)
    return run_guarded(spark, NAMED_MONTH_SQL, mart.read_mart(spark, base, month), month, lambda m: mart.read_mart(spark, base, m))


_STORAGE_SQL = "SELECT lineitem_usagetype AS usage_type, {cost} AS cost, '{label}' AS month FROM fact WHERE is_storage AND billing_ym = {month} GROUP BY 1"
register(
    "l03_named_month",
    named_month,
    with_cost(
        _STORAGE_SQL.format(cost=money("lineitem_unblendedcost"), label="1995-03", month="'199503'")
        + " UNION ALL "
        + _STORAGE_SQL.format(cost=money("lineitem_unblendedcost"), label="latest", month="(SELECT max(billing_ym) FROM fact)")
    ),
)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = ask(
        spark, "cost by usage type", "SELECT usage_type, cost FROM agg_storage_cost", stored_mart(spark, sf_dir)
    )
    numbers = record["numeric_summary"]["cost"]
    return spark.createDataFrame(
        [(record["row_count"], record["column_count"], record["error"], numbers["sum"], numbers["max"])],
        "row_count long, column_count int, error boolean, cost_sum double, cost_max double",
    )


register(
    "l04_ask",
    asked,
    with_cost(
        "SELECT count(*) AS row_count, 2 AS column_count, false AS error, coalesce(sum(cost), 0.0) AS cost_sum, coalesce(max(cost), 0.0) AS cost_max FROM"
        f" ({summary_sql('agg_storage_cost').replace('WHERE', 'WHERE billing_ym = (SELECT max(billing_ym) FROM fact) AND')})"
    ),
)

# ---- scenarios ---------------------------------------------------------------------------

register(
    "o01_month_total",
    lambda s, d: scenarios.month_total(rollups.summarise(facts(s, d), "monthly_summary")),
    with_cost(f"SELECT billing_ym, {money('lineitem_unblendedcost')} AS cost FROM fact WHERE billing_ym IS NOT NULL GROUP BY 1"),
)
register(
    "o02_endpoint_instances",
    lambda s, d: scenarios.endpoint_instances(rollups.summarise(odd_facts(s, d), "agg_endpoint_hours")).withColumn(
        "cost", F.round("cost", 2)
    ),
    with_cost(
        f"SELECT product_instancetype AS instance_type, coalesce(sum(usage_hours), 0.0) AS hours, round({money('lineitem_unblendedcost')}, 2) AS cost"
        " FROM fact WHERE is_endpoint GROUP BY 1",
        odd=True,
    ),
)
register(
    "o03_notebook_usage",
    lambda s, d: scenarios.notebook_usage(odd_facts(s, d)),
    with_cost(
        f"SELECT lineitem_usagetype AS usage_type, coalesce(sum(usage_hours), 0.0) AS hours, {money('lineitem_unblendedcost')} AS cost"
        " FROM fact WHERE is_notebook GROUP BY 1",
        odd=True,
    ),
)
register(
    "o04_spot_share",
    lambda s, d: scenarios.spot_share(rollups.summarise(facts(s, d), "agg_spot_ratio")).withColumn(
        "share", F.round("share", 6)
    ),
    with_cost(
        f"SELECT pricing_type, cost, round(cost / sum(cost) OVER (), 6) AS share FROM ({summary_sql('agg_spot_ratio')})"
    ),
)
register(
    "o04_costliest_training",
    lambda s, d: scenarios.costliest_training(rollups.summarise(facts(s, d), "agg_training_cost")),
    with_cost(
        f"SELECT * FROM ({summary_sql('agg_training_cost')}) ORDER BY cost DESC, account_id ASC NULLS FIRST, instance_type ASC NULLS FIRST LIMIT 10"
    ),
)
register(
    "o05_idle_endpoints",
    lambda s, d: scenarios.idle_endpoints(odd_facts(s, d), max_hours=2000.0),
    with_cost(
        f"""SELECT lineitem_resourceid AS resource_id, coalesce(sum(usage_hours), 0.0) AS hours, {money('lineitem_unblendedcost')} AS cost,
 count(DISTINCT product_instancetype) AS instances FROM fact WHERE is_endpoint AND lineitem_resourceid IS NOT NULL
 GROUP BY 1 HAVING coalesce(sum(usage_hours), 0.0) < 2000.0""",
        odd=True,
    ),
)
_EMPTY = [f"coalesce(trim(usertag{i}), '') = ''" for i in range(10)]
register(
    "o06_tag_missing_rate",
    lambda s, d: scenarios.tag_missing_rate(facts(s, d), [f"usertag{i}" for i in range(10)]).select(
        "account_id",
        "line_items",
        *[F.round(c, 6).alias(c) for c in ("untagged_rate", *[f"usertag{i}_missing" for i in range(10)])],
    ),
    with_cost(
        "SELECT lineitem_usageaccountid AS account_id, count(*) AS line_items,"
        f" round(avg(CASE WHEN {' AND '.join(_EMPTY)} THEN 1.0 ELSE 0.0 END), 6) AS untagged_rate, "
        + ", ".join(f"round(avg(CASE WHEN {_EMPTY[i]} THEN 1.0 ELSE 0.0 END), 6) AS usertag{i}_missing" for i in range(10))
        + " FROM fact GROUP BY 1"
    ),
)
register(
    "o06_uncategorised_cost",
    lambda s, d: scenarios.uncategorised_cost(facts(s, d)),
    with_cost(
        f"SELECT lineitem_usageaccountid AS account_id, {money('lineitem_unblendedcost')} AS cost FROM fact"
        f" WHERE {CATEGORY_SQL} = 'Other' GROUP BY 1"
    ),
)
_TREND_SQL = f"""SELECT billing_ym, unblended_cost AS cost,
 round(unblended_cost - lag(unblended_cost) OVER (ORDER BY billing_ym), 4) AS change,
 round(avg(unblended_cost) OVER (ORDER BY billing_ym ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS mean_before,
 coalesce(unblended_cost > 1.5 * avg(unblended_cost) OVER (ORDER BY billing_ym ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS is_spike
 FROM ({summary_sql('monthly_summary')})"""


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenarios.trend(rollups.summarise(facts(spark, sf_dir), "monthly_summary"))
    return rows.withColumns({c: F.round(c, 4) for c in ("change", "mean_before")})


register("o07_trend", trend, with_cost(_TREND_SQL))
register(
    "o07_last_months",
    lambda s, d: scenarios.last_months(trend(s, d)),
    with_cost(f"SELECT * FROM ({_TREND_SQL}) ORDER BY billing_ym DESC LIMIT 3"),
)
register(
    "o07_spike_causes",
    lambda s, d: scenarios.spike_causes(facts(s, d)).withColumn("change", F.round("change", 2)),
    with_cost(
        f"""SELECT billing_ym, category, cost, round(cost - lag(cost) OVER (PARTITION BY category ORDER BY billing_ym), 2) AS change
 FROM (SELECT billing_ym, {CATEGORY_SQL} AS category, {money('lineitem_unblendedcost')} AS cost FROM fact
 WHERE billing_ym IS NOT NULL GROUP BY 1, 2)"""
    ),
)
_SERVICE_SQL = " UNION ALL ".join(
    f"SELECT '{f[3:]}' AS service, {money('lineitem_unblendedcost')} AS cost, count(*) AS line_items FROM fact WHERE {f}"
    for f in scenarios.SERVICE_FLAGS
)
register("o08_service_costs", lambda s, d: scenarios.service_costs(facts(s, d)), with_cost(_SERVICE_SQL))
register(
    "o08_costliest_service",
    lambda s, d: scenarios.costliest_service(facts(s, d)),
    with_cost(f"SELECT * FROM ({_SERVICE_SQL}) ORDER BY cost DESC, service LIMIT 1"),
)
