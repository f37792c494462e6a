"""Ordered keyword classification of line items, URLs and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costdocs.functions.text import first_match, with_first_match
from costdocs.operators.joins import MAX_LOOKUP_ROWS, lookup_join

# Rules in the order they are tried; the first hit wins.
CATEGORY_RULES = (
    ("Endpoint", ("endpoint", "inference")),
    ("Notebook", ("notebook", "jupyter")),
    ("Training", ("training", "train", "model")),
    ("Processing", ("processing", "transform", "batch")),
)
# "rstudio" can never win, as "studio" is tried first; the order is part of the result.
URL_RULES = (
    ("studio", ("studio",)),
    ("notebook", ("notebook", "nbi")),
    ("training", ("training",)),
    ("inference", ("inference",)),
    ("autopilot", ("autopilot",)),
    ("feature_store", ("feature-store",)),
    ("monitoring", ("monitor",)),
    ("pipelines", ("pipeline",)),
    ("canvas", ("canvas",)),
    ("geospatial", ("geospatial",)),
    ("rstudio", ("rstudio",)),
    ("hyperpod", ("hyperpod",)),
    ("jupyter", ("jupyter",)),
    ("security", ("security",)),
    ("assets", ("assets",)),
    ("algorithms", ("algorithm",)),
    ("frameworks", ("framework",)),
    ("partner", ("partner",)),
    ("migration", ("migrate",)),
)
# Words for questions about documents are tried before words for questions about cost.
INTENT_RULES = (
    (
        "docs",
        (
            "설정", "방법", "방식", "개념", "설명", "가이드", "튜토리얼", "레퍼런스", "어떻게", "문서", "기능",
            "setup", "how to", "how do", "concept", "guide", "tutorial", "reference",
        ),
    ),
    (
        "sql",
        (
            "비용", "사용량", "합계", "집계", "통계", "추이", "월별", "테이블", "쿼리", "시간 합",
            "cost", "usage", "total", "aggregate", "trend", "monthly", "table", "query",
        ),
    ),
)
OTHER = "Other"
MAPPING_KEYS = ["lineitem_usagetype", "lineitem_operation", "product_productname"]


def with_rule_category(line_items: DataFrame, column: str = "rule_category") -> DataFrame:
    texts = [F.col("lineitem_usagetype"), F.col("lineitem_operation")]
    return with_first_match(line_items, column, texts, CATEGORY_RULES, OTHER)


def keyword_intent(question: Column) -> Column:
    return first_match(question, INTENT_RULES, "general")


def parse_category(model_text: Column) -> Column:
    """The ``category`` field of a JSON answer; bad JSON or no such field gives 'Other'."""
    parsed = F.try_parse_json(model_text)
    return F.coalesce(F.try_variant_get(parsed, "$.category", "string"), F.lit(OTHER))


def distinct_keys(line_items: DataFrame) -> DataFrame:
    """The key triples to classify: one row each, however many line items share it."""
    return line_items.select(*MAPPING_KEYS).distinct()


def apply_mapping(
    line_items: DataFrame, mapping: DataFrame, column: str = "llm_category", max_rows: int = MAX_LOOKUP_ROWS
) -> DataFrame:
    """Write a category per key triple back to every line item.

    Plain equality: a line item with a null key keeps 'Other'. ``mapping`` has the keys and
    ``category``; of several categories for one triple the last in order of text counts, so that
    no line item is multiplied.
    """
    categories = mapping.groupBy(*MAPPING_KEYS).agg(F.max("category").alias("_category"))
    joined = lookup_join(line_items, categories, MAPPING_KEYS, "left", max_rows)
    return joined.select(*line_items.columns, F.coalesce("_category", F.lit(OTHER)).alias(column))


def categorise(line_items: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """The external mapping when given and its keys exist, else the rules."""
    if mapping is not None and set(MAPPING_KEYS) <= set(line_items.columns):
        return apply_mapping(line_items, mapping)
    return with_rule_category(line_items)


def category_counts(urls: DataFrame) -> DataFrame:
    """How many distinct URLs each category has; empty categories do not appear.

    Counts are merged before the shuffle; the URLs of a category stay rows
    (:func:`urls_of_category`), as a category may hold most of them.
    """
    return with_category(urls).groupBy("category").agg(F.count("*").alias("n"))


def with_category(urls: DataFrame) -> DataFrame:
    distinct = urls.select("url").distinct()
    return with_first_match(distinct, "category", [F.col("url")], URL_RULES, "other").select("category", "url")


def urls_of_category(urls: DataFrame, category: str) -> DataFrame:
    return with_category(urls).where(F.col("category") == category)
