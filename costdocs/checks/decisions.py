"""Registered queries over model answers, intents and SQL logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.checks.fixtures import (
    intent_outputs,
    model_answers,
    query_log,
    questions,
    rated_answers,
    table,
    with_cost,
    with_intents,
    with_log,
    with_ratings,
)
from costdocs.checks.cost import extracted
from costdocs.checks.registry import register, written_once
from costdocs.operators import classify, decide, guard

# ---- guards and SQL texts ----------------------------------------------------------------

# The twins have lists of their own, so that a wrong word in the library shows.
_WORDS = r"\b(insert|update|delete|create|alter|drop|truncate|attach|copy|pragma)\b"
_WORD_REASON = f"""CASE WHEN NOT regexp_matches(trim(sql), '(?is)^\\s*select\\b') THEN 'not a SELECT'
 WHEN regexp_matches(rtrim(trim(sql), ';'), '(?is){_WORDS}') THEN 'forbidden keyword' END"""
_TEXT_REASON = f"""CASE WHEN regexp_matches(upper(sql), 'INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|TRUNCATE|GRANT|REVOKE|EXECUTE|CALL') THEN 'forbidden keyword'
 WHEN NOT starts_with(upper(trim(sql)), 'SELECT') THEN 'not a SELECT' END"""

register(
    "l01_word_guard",
    lambda s, d: guard.checked(query_log(s, d), guard.word_guard(F.col("sql"))),
    with_log(f"SELECT event_id, sql, {_WORD_REASON} AS reason, ({_WORD_REASON}) IS NULL AS ok FROM log"),
)
register(
    "l02_substring_guard",
    lambda s, d: guard.checked(query_log(s, d), guard.substring_guard(F.col("sql"))),
    with_log(f"SELECT event_id, sql, {_TEXT_REASON} AS reason, ({_TEXT_REASON}) IS NULL AS ok FROM log"),
)
register(
    "b23_month_paths",
    lambda s, d: query_log(s, d).select(
        "event_id",
        guard.month_paths(F.col("sql"), "data/processed/202508/").alias("fixed"),
        guard.table_views(F.col("sql")).alias("on_views"),
    ),
    with_log(
        "SELECT event_id, replace(sql, 'data/processed/latest', 'data/processed/202508') AS fixed,"
        " replace(sql, 'read_parquet(''data/processed/latest/monthly_summary.parquet'')', 'monthly_summary') AS on_views FROM log"
    ),
)
register(
    "k06_extract_sql",
    lambda s, d: model_answers(s, d).select("event_id", guard.extract_sql(F.col("answer")).alias("sql")),
    with_log(
        """SELECT event_id, CASE
 WHEN json_valid(bare) THEN coalesce(json_extract_string(bare, '$.sql'), '')
 WHEN found = '' THEN NULL WHEN ends_with(found, ';') THEN found ELSE concat(found, ';') END AS sql
FROM (SELECT event_id, bare, regexp_extract(bare, '(?is)select\\s+.*?(?:;|$)', 0) AS found
 FROM (SELECT event_id, trim(regexp_replace(regexp_replace(answer, '^```json', ''), '```$', ''), chr(10) || ' ') AS bare FROM log))"""
    ),
)
register(
    "k07_category_parse",
    lambda s, d: model_answers(s, d).select(
        "event_id", classify.parse_category(F.col("category_text")).alias("category")
    ),
    with_log(
        "SELECT event_id, CASE WHEN json_valid(category_text) THEN coalesce(json_extract_string(category_text, '$.category'), 'Other')"
        " ELSE 'Other' END AS category FROM log"
    ),
)

# ---- intents -----------------------------------------------------------------------------

_INTENT_SQL = """SELECT conv_id, turn,
 CASE WHEN trim(question) = '' OR bad THEN 'general' ELSE coalesce(label, 'general') END AS intent,
 CASE WHEN trim(question) = '' THEN 0.5 WHEN bad THEN 0.3 ELSE coalesce(try_cast(confidence AS double), 0.0) END AS intent_confidence
FROM (SELECT *, (label IS NULL AND confidence IS NULL) OR coalesce(label NOT IN ('sql', 'docs', 'general'), false)
  OR (confidence IS NOT NULL AND try_cast(confidence AS double) IS NULL) AS bad FROM outputs)"""
register(
    "k01_intent_normalise",
    lambda s, d: decide.normalise_intents(intent_outputs(s, d)).select("conv_id", "turn", "intent", "intent_confidence"),
    with_intents(_INTENT_SQL),
)


_INTENTS = (
    ("docs", "설정 방법 방식 개념 설명 가이드 튜토리얼 레퍼런스 어떻게 문서 기능 setup concept guide tutorial reference".split() + ["how to", "how do"]),
    ("sql", "비용 사용량 합계 집계 통계 추이 월별 테이블 쿼리 cost usage total aggregate trend monthly table query".split() + ["시간 합"]),
)


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(question), '{w}')" for w in words) + ")"


register(
    "k02_keyword_intent",
    lambda s, d: questions(s, d).select("conv_id", "turn", classify.keyword_intent(F.col("question")).alias("intent")),
    with_intents(
        "SELECT conv_id, turn, CASE "
        + " ".join(f"WHEN {_any(words)} THEN '{label}'" for label, words in _INTENTS)
        + " ELSE 'general' END AS intent FROM asked"
    ),
)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_once(
        spark,
        sf_dir,
        "routes",
        lambda p: decide.write_routes(decide.normalise_intents(intent_outputs(spark, sf_dir)), p),
    )
    return decide.route_counts(spark.read.parquet(path))


register("k03_route_by_intent", routed, with_intents(f"SELECT intent, count(*) AS n FROM ({_INTENT_SQL}) GROUP BY 1"))

# ---- answers -----------------------------------------------------------------------------

_GATE_SQL = """(overall_score IS NULL OR coalesce(overall_score, 5) < 6
 OR least(coalesce(completeness, 5), coalesce(accuracy, 5), coalesce(specificity, 5), coalesce(clarity, 5)) < 4
 OR coalesce(length(answer), 0) < 200)"""
register(
    "k04_quality_gate",
    lambda s, d: rated_answers(s, d).select("doc_id", decide.needs_second_answer(200).alias("needs_second")),
    with_ratings(f"SELECT doc_id, {_GATE_SQL} AS needs_second FROM rated"),
)


def best_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rated_answers(spark, sf_dir)
    first = rated.select("doc_id", "answer", F.col("overall_score").alias("score"))
    second = rated.where(decide.needs_second_answer(200)).select(
        "doc_id", F.concat(F.lit("again: "), "answer").alias("answer"), (F.col("n_chars") % 11).cast("double").alias("score")
    )
    return decide.best_of_two(first, second, "doc_id").select("doc_id", "chosen", F.md5("answer").alias("answer_md5"))


register(
    "k05_best_of_two",
    best_answers,
    with_ratings(
        f"""SELECT doc_id, CASE WHEN wins THEN 'second' ELSE 'first' END AS chosen,
 md5(CASE WHEN wins THEN concat('again: ', answer) ELSE answer END) AS answer_md5
 FROM (SELECT *, {_GATE_SQL} AND n_chars % 11 > coalesce(overall_score, 0) AS wins FROM rated)"""
    ),
)


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    predicted = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 300).cast("int").alias("label"))
    return decide.accuracy(predicted, gold, "doc_id").withColumn("accuracy", F.round("accuracy", 6))


register(
    "d17_accuracy",
    accuracy,
    """SELECT cast(sum(ok) AS bigint) AS correct, count(*) AS total, round(avg(ok), 6) AS accuracy, avg(ok) >= 0.8 AS passed
FROM (SELECT CASE WHEN quality = CASE WHEN n_chars > 300 THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS ok
 FROM labels LEFT JOIN documents ON labels.doc_id = documents.doc_id)""",
)
_LONG, _LONG_SUFFIX = 2000, "...\n\n(답변이 길어서 일부만 표시됩니다. 더 구체적인 질문을 해주세요.)"
_REPLY, _REPLY_SUFFIX = 1000, " …"
register(
    "h08_truncate",
    lambda s, d: table(s, d, "documents").select(
        "doc_id", F.md5(decide.cut_answer(F.col("text"))).alias("answer"), F.md5(decide.cut_reply(F.col("text"))).alias("reply")
    ),
    f"""SELECT doc_id,
 md5(CASE WHEN length(text) > {_LONG} THEN concat(left(text, {_LONG}), '{_LONG_SUFFIX}') ELSE text END) AS answer,
 md5(CASE WHEN length(text) > {_REPLY} THEN concat(left(text, {_REPLY}), '{_REPLY_SUFFIX}') ELSE text END) AS reply
 FROM documents""",
)

# ---- URL categories ----------------------------------------------------------------------

_URL = "concat('https://docs.example.com/', lineitem_operation, '/', coalesce(lineitem_usagetype, 'index'), '/', product_region, '.html')"
_URL_WORDS = (
    ("studio", ["studio"]), ("notebook", ["notebook", "nbi"]), ("training", ["training"]), ("inference", ["inference"]),
    ("autopilot", ["autopilot"]), ("feature_store", ["feature-store"]), ("monitoring", ["monitor"]), ("pipelines", ["pipeline"]),
    ("canvas", ["canvas"]), ("geospatial", ["geospatial"]), ("rstudio", ["rstudio"]), ("hyperpod", ["hyperpod"]), ("jupyter", ["jupyter"]),
    ("security", ["security"]), ("assets", ["assets"]), ("algorithms", ["algorithm"]), ("frameworks", ["framework"]),
    ("partner", ["partner"]), ("migration", ["migrate"]),
)
_URL_SQL = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(url), '{w}')" for w in words) + f" THEN '{label}'"
        for label, words in _URL_WORDS
    )
    + " ELSE 'other' END"
)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).selectExpr(f"{_URL} AS url")


register(
    "i09_url_category",
    lambda s, d: classify.with_category(urls(s, d)),
    with_cost(f"SELECT {_URL_SQL} AS category, url FROM (SELECT DISTINCT {_URL} AS url FROM ext)"),
)
register(
    "d15_category_counts",
    lambda s, d: classify.category_counts(urls(s, d)),
    with_cost(f"SELECT {_URL_SQL} AS category, count(*) AS n FROM (SELECT DISTINCT {_URL} AS url FROM ext) GROUP BY 1"),
)
register(
    "i09_urls_of_category",
    lambda s, d: classify.urls_of_category(urls(s, d), "training"),
    with_cost(
        f"SELECT 'training' AS category, url FROM (SELECT DISTINCT {_URL} AS url FROM ext) WHERE {_URL_SQL} = 'training'"
    ),
)
