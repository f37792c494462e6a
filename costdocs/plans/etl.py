"""One month from line items to the stored mart, as one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.operators.classify import categorise
from costdocs.plans import mart
from costdocs.sources import cost as cost_source
from costdocs.sources.contracts import choose_line_items


def run_month(
    spark: SparkSession,
    base: str,
    month: str,
    cost: DataFrame | None = None,
    csv_path: str | None = None,
    contracts: DataFrame | None = None,
    contract_id: str | None = None,
    account_ids: Sequence[str] | None = None,
    limit: int | None = None,
    categories: bool = False,
    mapping: DataFrame | None = None,
    csv: bool = False,
) -> dict:
    """Extract, keep a raw snapshot, transform, store one month and sum up what was stored.

    Line items come from a table, filtered by month, accounts, type and product, or from a CSV
    file, which is taken as it is: all its rows become this month's mart.
    """
    month = month.replace("-", "")
    if csv_path is not None:
        found = cost_source.read_csv(spark, csv_path)
    elif cost is not None:
        found = cost_source.extract(choose_line_items(cost, contracts, contract_id, account_ids), [month], limit=limit)
    else:
        raise ValueError("give a cost table or a CSV file")

    snapshot = f"{base}/raw/{cost_source.SNAPSHOT}_{month}"
    cost_source.write_snapshot(found, f"{snapshot}.parquet")
    raw = spark.read.parquet(f"{snapshot}.parquet")
    cost_source.write_csv_sample(raw, f"{snapshot}.csv")

    mart.write_month(spark, categorise(raw, mapping) if categories else raw, base, month, csv=csv)
    counts = mart.manifest_counts(mart.read_manifest(spark, base).where(F.col(mart.MONTH) == month))
    sizes = mart.mart_sizes(spark, base, month)
    total = mart.mart_total_size(spark, base, month).first()
    return {
        "billing_ym": month,
        "raw_rows": raw.count(),
        "row_counts": {r["table"]: r["rows"] for r in counts.collect()},
        "files": {r["table"]: r["size_mb"] for r in sizes.collect()},
        "total_size_mb": total["total_size_mb"] if total else 0.0,
    }
