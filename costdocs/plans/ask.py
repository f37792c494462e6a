"""A prepared question: month, guarded SQL over that month's tables, profile of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.operators.guard import run_guarded
from costdocs.operators.profile import summary
from costdocs.plans.mart import catalog_json, read_mart, resolve_month
from costdocs.sources.scratch import scratch_table

SAMPLE_ROWS = 5


def error_record(question: str, error: Exception) -> dict:
    return {
        "answer": f"'{question}': {error}",
        "error": True,
        "error_message": str(error),
        "sql": None,
        "sample_rows": [],
        "row_count": 0,
        "column_count": 0,
        "numeric_summary": {},
        "source_files": [],
        "intent": "sql",
    }


def _sample_and_numbers(spark: SparkSession, result: DataFrame) -> tuple[list[dict], dict]:
    """First rows and profile of one run of the query, whose result is written to the shared folder once."""
    places = [f"c{i}" for i in range(len(result.columns))]
    kinds = [F.col(p).cast("string").alias(p) if f.dataType.typeName() == "void" else F.col(p) for p, f in zip(places, result.schema.fields)]
    with scratch_table(spark, "answer") as path:
        result.toDF(*places).select(*kinds).write.parquet(path)
        stored = spark.read.parquet(path).toDF(*result.columns)
        return [r.asDict() for r in stored.limit(SAMPLE_ROWS).collect()], summary(stored)


def ask(spark: SparkSession, question: str, sql: str, base: str, month: str = "latest", debug: bool = False) -> dict:
    """Run prepared SQL over one month of the mart; a failure becomes an error record."""
    try:
        chosen = resolve_month(spark, base, month)
        views = read_mart(spark, base, chosen)
        result = run_guarded(spark, sql, views, chosen, lambda other: read_mart(spark, base, other))
        sample, numbers = _sample_and_numbers(spark, result)
        record = {
            "answer": None,
            "sql": sql,
            "sample_rows": sample,
            **numbers,
            "source_files": sorted(views),
            "intent": "sql",
            "error": False,
        }
        if debug:
            record["debug"] = {"month": chosen, "base_dir": base, "schema_json": catalog_json(views)}
        return record
    except Exception as error:
        record = error_record(question, error)
        if debug:
            record["debug"] = {"error_type": type(error).__name__, "error_details": str(error)}
        return record
