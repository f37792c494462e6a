"""Inputs of the registered queries, made from the generated tables.

Each input exists twice: as a DataFrame and as DuckDB SQL for the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.operators.flags import FLAGS
from costdocs.sources.scan import read_table


# The tables on which costly work is done row by row.
SPREAD_BY = {"lineitem": "l_orderkey", "pages": "page_id", "documents": "doc_id", "events": "event_id"}


_HANDLES: dict[tuple, DataFrame] = {}


def _handle(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The plan of an input, made once per application; no data is kept."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    if key not in _HANDLES:
        _HANDLES[key] = make()
    return _HANDLES[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return _handle(spark, sf_dir, name, lambda: read_table(spark, path, SPREAD_BY.get(name)))


# ---- cost line items over the star schema ------------------------------------------------

# Column name -> expression; {…} marks the few spots where the two engines differ.
_COST = {
    "bill_billingperiodstartdate": "cast(date_trunc('month', l_shipdate) AS date)",
    "bill_billingperiodenddate": "{next_month}",
    "billing_ym": "{ym}",
    "lineitem_usageaccountid": "lpad(cast(o_custkey AS {string}), 12, '0')",
    "lineitem_resourceid": "CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE concat('res-', cast(l_suppkey AS {string})) END",
    "lineitem_usageamount": "l_quantity",
    "lineitem_unblendedcost": (
        "CASE WHEN l_partkey % 97 = 0 THEN 'n/a' ELSE cast(cast(l_extendedprice AS decimal(18,2)) AS {string}) END"
    ),
    "lineitem_blendedcost": (
        "cast(cast(l_extendedprice AS decimal(12,2)) * cast(1 - l_discount AS decimal(4,2)) AS {string})"
    ),
    "lineitem_currencycode": "'USD'",
    "lineitem_productcode": "CASE WHEN l_partkey % 11 = 0 THEN 'AmazonEC2' ELSE 'AmazonSageMaker' END",
    "lineitem_usagetype": (
        "CASE l_partkey % 13 WHEN 0 THEN 'R1-Host:ml.m5' WHEN 1 THEN 'R1-Endpoint:ml.c5'"
        " WHEN 2 THEN 'R1-Notebk:ml.t3' WHEN 3 THEN 'R1-Train:ml.p3' WHEN 4 THEN 'R1-SpotTrain:ml.p3'"
        " WHEN 5 THEN 'R1-Studio:KernelGateway' WHEN 6 THEN 'R1-Studio-Notebook:ml.t3'"
        " WHEN 7 THEN 'R1-FeatureStore:Write' WHEN 8 THEN 'R1-Processing:ml.m5' WHEN 9 THEN 'R1-Data-Bytes-Out'"
        " WHEN 10 THEN 'R1-Host:VolumeUsage.gp2' WHEN 11 THEN NULL ELSE 'R1-Misc' END"
    ),
    "lineitem_operation": (
        "CASE l_returnflag WHEN 'A' THEN 'RunInstance' WHEN 'R' THEN 'CreateTrainingJob' ELSE 'BatchTransform' END"
    ),
    "lineitem_lineitemtype": "CASE WHEN l_linenumber % 7 = 0 THEN 'Tax' ELSE 'Usage' END",
    "product_productname": "CASE WHEN l_partkey % 11 = 0 THEN 'Amazon EC2' ELSE 'Amazon SageMaker' END",
    "product_instancetype": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE concat('ml.', lower(p_type)) END",
    "product_instancetypefamily": "p_brand",
    "product_region": "n_name",
    "pricing_unit": "CASE l_linestatus WHEN 'O' THEN 'Hrs' ELSE 'GB-Mo' END",
    "pricing_term": "CASE WHEN l_tax > 0.04 THEN 'OnDemand' ELSE NULL END",
    "usertag0": "c_mktsegment",
    "usertag1": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END",
    "usertag2": "CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE o_orderstatus END",
    **{f"usertag{i}": "cast(NULL AS {string})" for i in range(3, 10)},
}
_SPARK = {
    "string": "string",
    "ym": "date_format(l_shipdate, 'yyyyMM')",
    "next_month": "add_months(cast(date_trunc('month', l_shipdate) AS date), 1)",
}
_DUCK = {
    "string": "varchar",
    "ym": "strftime(l_shipdate, '%Y%m')",
    "next_month": "cast(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS date)",
}


def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handle(spark, sf_dir, "cost line items", lambda: _cost_table(spark, sf_dir))


def _cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All billing line items. Join strategies are left to the sizes Spark measures.

    Orders meet their customers first, so that line items are moved for few keys only, and with few columns.
    """
    t = lambda name: table(spark, sf_dir, name)
    placed = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ordered = t("orders").join(placed, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        t("lineitem")
        .join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return joined.selectExpr(*[f"{e.format(**_SPARK)} AS {name}" for name, e in _COST.items()])


_CUR_SQL = (
    "SELECT "
    + ",\n ".join(f"{e.format(**_DUCK)} AS {name}" for name, e in _COST.items())
    + "\nFROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
)


def _like(column: str, *words: str) -> str:
    return " OR ".join(f"coalesce({column} ILIKE '%{w}%', false)" for w in words)


_FLAG_SQL = {
    "is_endpoint": _like("lineitem_usagetype", "Host", "Endpoint"),
    "is_notebook": _like("lineitem_usagetype", "Notebook", "Notebk"),
    "is_training": _like("lineitem_usagetype", "Train") + " OR " + _like("lineitem_operation", "Train"),
    "is_spot": _like("lineitem_usagetype", "Spot"),
    "is_studio": _like("lineitem_usagetype", "Studio"),
    "is_featurestore": _like("lineitem_usagetype", "FeatureStore"),
    "is_processing": _like("lineitem_usagetype", "Processing"),
    "is_data_transfer": _like("lineitem_usagetype", "Data-Bytes", "DataTransfer"),
    "is_storage": _like("lineitem_usagetype", "VolumeUsage", "Storage"),
}
assert list(_FLAG_SQL) == list(FLAGS)

HOURS_SQL = (
    f"CASE WHEN ({_like('pricing_unit', 'Hrs', 'Hours', 'Hour')}) AND NOT isnan(lineitem_usageamount) THEN lineitem_usageamount END"
)


def _cost_sql(column: str) -> str:
    return f"coalesce(try_cast({column} AS decimal(28,10)), 0)"


CATEGORY_SQL = (
    "CASE WHEN "
    + " WHEN ".join(
        f"({_like('lineitem_usagetype', *words)} OR {_like('lineitem_operation', *words)}) THEN '{label}'"
        for label, words in {
            "Endpoint": ("endpoint", "inference"),
            "Notebook": ("notebook", "jupyter"),
            "Training": ("training", "train", "model"),
            "Processing": ("processing", "transform", "batch"),
        }.items()
    )
    + " ELSE 'Other' END"
)


# Amounts that are no number or missing, for the queries that add up hours.
_ODD_AMOUNT = (
    "CASE WHEN lineitem_blendedcost LIKE '%7' THEN cast('NaN' AS double)"
    " WHEN lineitem_blendedcost LIKE '%3' THEN NULL ELSE lineitem_usageamount END"
)


def with_odd_amounts(line_items: DataFrame) -> DataFrame:
    return line_items.withColumn("lineitem_usageamount", F.expr(_ODD_AMOUNT))


def with_cost(body: str, odd: bool = False) -> str:
    """DuckDB SQL over ``cur`` (all line items), ``ext`` (extracted) and ``fact`` (flagged).

    With ``odd`` the extracted ones have :func:`with_odd_amounts`.
    """
    amounts = f" REPLACE ({_ODD_AMOUNT} AS lineitem_usageamount)" if odd else ""
    flags = ",\n ".join(f"({sql}) AS {name}" for name, sql in _FLAG_SQL.items())
    return (
        f"WITH cur AS ({_CUR_SQL}),\n"
        f"ext AS (SELECT *{amounts} FROM cur WHERE lineitem_lineitemtype = 'Usage'"
        " AND contains(product_productname, 'SageMaker')),\n"
        f"fact AS (SELECT * EXCLUDE (lineitem_unblendedcost, lineitem_blendedcost),"
        f" {_cost_sql('lineitem_unblendedcost')} AS lineitem_unblendedcost,"
        f" {_cost_sql('lineitem_blendedcost')} AS lineitem_blendedcost,\n {flags},\n"
        f" {HOURS_SQL} AS usage_hours FROM ext)\n{body}"
    )


def money(expression: str) -> str:
    """DuckDB: an exact sum as a double; the test costs have at most four decimals."""
    return f"cast(cast(coalesce(sum({expression}), 0) AS decimal(24,4)) AS double)"


# ---- contracts ---------------------------------------------------------------------------

CONTRACT_SIZE = 100  # accounts per contract, so that one contract record stays small


def contract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract-file texts (``value``): one contract per block of customers, each in a text.

    The first contract is the default one; every seventh has no accounts.
    """
    block = F.expr(f"cast(c_custkey div {CONTRACT_SIZE} AS int)")
    account = F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    grouped = (
        table(spark, sf_dir, "customer")
        .groupBy(block.alias("block"))
        .agg(F.array_sort(F.collect_list(account)).alias("all_accounts"))
    )
    name = F.concat(F.lit("contract-"), F.col("block").cast("string"))
    contract = F.struct(
        F.concat(F.lit("Block "), F.col("block").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.when(F.col("block") % 7 == 6, F.array().cast("array<string>")).otherwise(F.col("all_accounts")).alias("accounts"),
        F.lit("owner").alias("billing_owner"),
        F.array(F.lit("env"), F.lit("prod")).alias("tags"),
    )
    file = F.struct(F.create_map(name, contract).alias("contracts"), F.lit("contract-0").alias("default_contract"))
    return grouped.select(F.to_json(file).alias("value"))


CONTRACT_SQL = f"""contracts AS (
 SELECT concat('contract-', cast(block AS varchar)) AS contract_id, concat('Block ', cast(block AS varchar)) AS name,
  block = 0 AS is_default, CASE WHEN block % 7 = 6 THEN [] ELSE accounts END AS accounts
 FROM (SELECT c_custkey // {CONTRACT_SIZE} AS block,
   list(lpad(cast(c_custkey AS varchar), 12, '0') ORDER BY lpad(cast(c_custkey AS varchar), 12, '0')) AS accounts
  FROM customer GROUP BY 1))"""


# ---- SQL logs and model answers ----------------------------------------------------------

_SQL_TEXT = """CASE event_type
 WHEN 'view' THEN concat(' select user_id, sum(value) from read_parquet(''data/processed/latest/monthly_summary.parquet'') where user_id = ', cast(user_id AS {string}), ' ;')
 WHEN 'click' THEN concat('SELECT created_at FROM fact_sagemaker_costs WHERE id = ', cast(event_id AS {string}))
 WHEN 'signup' THEN concat('INSERT INTO users SELECT ', cast(user_id AS {string}))
 WHEN 'purchase' THEN concat('SELECT * FROM orders; DROP TABLE t', cast(event_id AS {string}))
 ELSE concat('WITH a AS (SELECT ', cast(event_id AS {string}), ') SELECT * FROM a') END"""

_ANSWER_TEXT = """CASE event_type
 WHEN 'view' THEN concat('```json', chr(10), '{{"sql": "SELECT ', cast(event_id AS {string}), '"}}', chr(10), '```')
 WHEN 'click' THEN concat('Here it is: select a', chr(10), 'from t', cast(event_id AS {string}), '; and more')
 WHEN 'signup' THEN concat('No query for user ', cast(user_id AS {string}))
 WHEN 'purchase' THEN concat('{{"other": ', cast(event_id AS {string}), '}}')
 ELSE concat('SELECT count(*) FROM e', cast(event_id AS {string})) END"""

_CATEGORY_TEXT = """CASE event_type WHEN 'view' THEN '{{"category": "Endpoint"}}' WHEN 'click' THEN '{{"category": "Training"}}'
 WHEN 'signup' THEN 'Training, I think' WHEN 'purchase' THEN '{{"kind": "Notebook"}}' ELSE props END"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_SQL_TEXT.format(string='string')} AS sql")


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        f"{_ANSWER_TEXT.format(string='string')} AS answer",
        f"{_CATEGORY_TEXT.format()} AS category_text",
    )


def with_log(body: str) -> str:
    return (
        f"WITH log AS (SELECT event_id, {_SQL_TEXT.format(string='varchar')} AS sql,"
        f" {_ANSWER_TEXT.format(string='varchar')} AS answer, {_CATEGORY_TEXT.format()} AS category_text FROM events)\n{body}"
    )


_INTENT_OUTPUT = {
    "question": "CASE WHEN role = 'system' THEN '  ' ELSE text END",
    "label": "CASE WHEN turn = 2 THEN 'chat' WHEN turn = 3 THEN NULL WHEN role = 'user' THEN 'sql' ELSE 'docs' END",
    "confidence": "CASE WHEN turn = 0 OR conv_id % 2 = 0 AND turn = 3 THEN NULL WHEN turn = 1 THEN '0.75' WHEN turn = 4 THEN 'high' ELSE '0.9' END",
}
_QUESTION = (
    "CASE role WHEN 'user' THEN concat(text, ' 비용') WHEN 'assistant' THEN concat('비용 계산 방법: ', text) ELSE text END"
)


def intent_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"{e} AS {c}" for c, e in _INTENT_OUTPUT.items()]
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", *columns)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{_QUESTION} AS question")


def with_intents(body: str) -> str:
    columns = ", ".join(f"{e} AS {c}" for c, e in _INTENT_OUTPUT.items())
    return (
        f"WITH outputs AS (SELECT conv_id, turn, {columns} FROM conversations),\n"
        f"asked AS (SELECT conv_id, turn, role, {_QUESTION} AS question FROM conversations)\n{body}"
    )


# Every document is an answer; labels give the scores, so that answers without one lack scores.
_QUALITY = {
    "overall_score": "CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 7.5D ELSE 5.0D END",
    "completeness": "CASE WHEN quality IS NULL THEN NULL ELSE 3.0D + quality + toxic END",
    "accuracy": "CASE WHEN quality IS NULL THEN NULL ELSE 6.0D - 3 * toxic END",
    "specificity": "CASE WHEN quality IS NULL THEN NULL ELSE 6.0D END",
    "clarity": "CASE WHEN quality IS NULL THEN NULL ELSE 8.0D END",
}


def rated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.selectExpr("doc_id", "text AS answer", "n_chars", "quality", *[f"{e} AS {c}" for c, e in _QUALITY.items()])


def with_ratings(body: str) -> str:
    columns = ", ".join(f"{e.replace('0D', '0').replace('5D', '5')} AS {c}" for c, e in _QUALITY.items())
    return (
        f"WITH rated AS (SELECT documents.doc_id AS doc_id, text AS answer, n_chars, quality, {columns}"
        f" FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)\n{body}"
    )


# ---- vectors -----------------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query vectors: the mean vector of every label, over all embeddings."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("embedding")
    )


def corpus_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and metadata of the vectors: vector n belongs to document n. Some values are missing."""
    return table(spark, sf_dir, "documents").selectExpr(*[f"{e.format(string='string')} AS {c}" for c, e in _TEXTS.items()])


_TEXTS = {
    "vec_id": "doc_id",
    "text": "text",
    "id": "CASE WHEN lang = 'en' THEN concat('id-', cast(doc_id AS {string})) WHEN lang = 'fr' THEN '' ELSE NULL END",
    "chunk_id": "CASE WHEN lang = 'de' THEN NULL ELSE concat('chunk-', cast(doc_id AS {string})) END",
    "title": "'Title ' || lang",
    "section": "CASE WHEN lang = 'es' THEN NULL ELSE 'General' END",
    "source": "CASE WHEN source = 'src3' THEN NULL ELSE source END",
}


def with_vectors(body: str, k: int) -> str:
    """DuckDB SQL over ``hits`` (query_id, id, raw_score, rank) and ``texts``."""
    texts = ", ".join(f"{e.format(string='varchar')} AS {c}" for c, e in _TEXTS.items())
    return f"""WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(cast(x AS double)) AS x FROM parts GROUP BY 1, 2),
queries AS (SELECT label AS query_id, list(x ORDER BY pos) AS q FROM means GROUP BY 1),
pairs AS (SELECT query_id, vec_id AS id,
  list_cosine_similarity(q, cast(embedding AS double[])) AS raw_score FROM embeddings CROSS JOIN queries),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, id) AS rank FROM pairs),
hits AS (SELECT * FROM ranked WHERE rank <= {k}),
scored AS (SELECT *, greatest(0.0, least(1.0, (raw_score + 1) / 2)) AS score,
  avg(greatest(0.0, least(1.0, (raw_score + 1) / 2))) OVER (PARTITION BY query_id) AS avg_score FROM hits),
texts AS (SELECT {texts} FROM documents)
{body}"""
