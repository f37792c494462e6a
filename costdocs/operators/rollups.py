"""The ten cost summaries, each on its own or all from one scan and one shuffle.

Sums of groups without any value are 0, not null. Null keys are groups of their own, but
for the month. Every sum is merged inside the map tasks first, so a hot key reaches the
shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costdocs.operators.flags import pricing_type


@dataclass(frozen=True)
class Rollup:
    table: str
    flag: str | None
    keys: tuple[tuple[str, str], ...]  # (output name, fact column)
    measures: tuple[tuple[str, str], ...] = (("cost", "lineitem_unblendedcost"),)


HOURS_AND_COST = (("hours", "usage_hours"), ("cost", "lineitem_unblendedcost"))
INSTANCE = ("instance_type", "product_instancetype")
USAGE_TYPE = ("usage_type", "lineitem_usagetype")

# Names, conditions, keys and measures of the ten summaries.
ROLLUPS = (
    Rollup("agg_endpoint_hours", "is_endpoint", (("resource_id", "lineitem_resourceid"), INSTANCE), HOURS_AND_COST),
    Rollup("agg_training_cost", "is_training", (("account_id", "lineitem_usageaccountid"), INSTANCE)),
    Rollup("agg_notebook_hours", "is_notebook", (INSTANCE,), HOURS_AND_COST),
    Rollup("agg_studio_hours", "is_studio", (INSTANCE,), HOURS_AND_COST),
    Rollup("agg_featurestore_cost", "is_featurestore", (USAGE_TYPE,)),
    Rollup("agg_processing_cost", "is_processing", (INSTANCE,)),
    Rollup("agg_datatransfer_cost", "is_data_transfer", (USAGE_TYPE,)),
    Rollup("agg_storage_cost", "is_storage", (USAGE_TYPE,)),
    Rollup("agg_spot_ratio", None, (("pricing_type", "pricing_type"),)),
    Rollup(
        "monthly_summary",
        None,
        (("billing_ym", "billing_ym"),),
        (("unblended_cost", "lineitem_unblendedcost"), ("blended_cost", "lineitem_blendedcost")),
    ),
)
ROLLUP = {r.table: r for r in ROLLUPS}
FACT_TABLE = "fact_sagemaker_costs"
TABLES = (FACT_TABLE, *ROLLUP)


def total(column: str) -> Column:
    """A sum as a double, 0 for a group without values."""
    return F.coalesce(F.sum(column).cast("double"), F.lit(0.0))


def _key(column: str) -> Column:
    return pricing_type() if column == "pricing_type" else F.col(column)


def _applies(rollup: Rollup) -> Column:
    if rollup.flag:
        return F.col(rollup.flag)
    if rollup.table == "monthly_summary":
        return F.col("billing_ym").isNotNull()
    return F.lit(True)


def summarise(fact: DataFrame, table: str, by: Sequence[str] = ()) -> DataFrame:
    """One summary table; with ``by`` for each value of these columns apart."""
    rollup = ROLLUP[table]
    keys = [_key(column).alias(name) for name, column in rollup.keys]
    return (
        fact.where(_applies(rollup))
        .groupBy(*by, *keys)
        .agg(*[total(column).alias(name) for name, column in rollup.measures])
    )


MEASURE_OF = {"usage_hours": "hours", "lineitem_unblendedcost": "unblended", "lineitem_blendedcost": "blended"}


def _measured(column: str) -> Column:
    """A measure where the target table has it, so that nothing is added up in vain."""
    having = [r.table for r in ROLLUPS if column in dict(r.measures).values()]
    return F.col(column) if len(having) == len(ROLLUPS) else F.when(F.col("table").isin(having), F.col(column))


def summarise_all(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All ten summaries as rows (table, key1, key2, hours, unblended, blended).

    One scan and one shuffle: each line item is offered to the tables whose condition it
    meets, and one aggregation runs over (table, keys). Measures that a table does not have
    are 0. Use :func:`pick` to take one table out.
    """
    null = F.lit(None).cast("string")
    offers = []
    for rollup in ROLLUPS:
        keys = [_key(column).cast("string") for _, column in rollup.keys] + [null]
        target = F.struct(F.lit(rollup.table).alias("table"), keys[0].alias("key1"), keys[1].alias("key2"))
        offers.append(F.when(_applies(rollup), target))
    offered = fact.select(*by, F.explode(F.array(*offers)).alias("target"), *MEASURE_OF)
    return (
        offered.where(F.col("target").isNotNull())
        .select(*by, "target.*", *MEASURE_OF)
        .withColumns({column: _measured(column) for column in MEASURE_OF})
        .groupBy(*by, "table", "key1", "key2")
        .agg(*[total(column).alias(name) for column, name in MEASURE_OF.items()])
    )


def pick(all_rows: DataFrame, table: str, by: Sequence[str] = ()) -> DataFrame:
    """One summary table out of :func:`summarise_all`."""
    rollup = ROLLUP[table]
    keys = [F.col(f"key{i}").alias(name) for i, (name, _) in enumerate(rollup.keys, 1)]
    measures = [F.col(MEASURE_OF[column]).alias(name) for name, column in rollup.measures]
    return all_rows.where(F.col("table") == table).select(*by, *keys, *measures)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table; an empty table counts 0."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
