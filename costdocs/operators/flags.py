"""Columns derived from a line item: usage flags, hours, clean costs, price type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.functions.text import contains_any, holds_any, searched
from costdocs.sources.cost import COST_COLUMNS

USAGE = "lineitem_usagetype"
OPERATION = "lineitem_operation"

# Columns and words that set each flag. Flags may overlap.
FLAGS: dict[str, tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]] = {
    "is_endpoint": (((USAGE,), ("Host", "Endpoint")),),
    "is_notebook": (((USAGE,), ("Notebook", "Notebk")),),
    "is_training": (((USAGE, OPERATION), ("Train",)),),
    "is_spot": (((USAGE,), ("Spot",)),),
    "is_studio": (((USAGE,), ("Studio",)),),
    "is_featurestore": (((USAGE,), ("FeatureStore",)),),
    "is_processing": (((USAGE,), ("Processing",)),),
    "is_data_transfer": (((USAGE,), ("Data-Bytes", "DataTransfer")),),
    "is_storage": (((USAGE,), ("VolumeUsage", "Storage")),),
}
HOUR_UNITS = ("Hrs", "Hours", "Hour")

# Bills carry up to ten decimals. Exact sums do not depend on task order or on retries.
COST_TYPE = T.DecimalType(28, 10)


def flag(name: str) -> Column:
    ((columns, words),) = FLAGS[name]
    return contains_any([F.col(c) for c in columns], words)


def usage_hours() -> Column:
    """The used amount where it is priced by the hour, else null; an amount that is no number counts as none."""
    amount = F.nanvl(F.col("lineitem_usageamount").cast("double"), F.lit(None).cast("double"))
    return F.when(contains_any(F.col("pricing_unit"), HOUR_UNITS), amount)


def clean_cost(c: Column) -> Column:
    """A cost as a number, rounded to ten decimals; null, NaN, infinity and unreadable text become 0.

    A finite cost with more than 18 digits before the point ends the job: it must not become 0 unseen.
    """
    exact, near = c.try_cast(COST_TYPE), c.try_cast("double")
    finite = near.isNotNull() & ~F.isnan(near) & (F.abs(near) < float("inf"))
    too_large = F.raise_error(F.concat(F.lit("cost out of range: "), c.cast("string"))).cast(COST_TYPE)
    return F.when(exact.isNotNull(), exact).when(finite, too_large).otherwise(F.lit(0).cast(COST_TYPE))


def pricing_type() -> Column:
    return F.when(F.col("is_spot"), "Spot").otherwise("OnDemand")


def fact(line_items: DataFrame) -> DataFrame:
    """All line items with flags, hours and clean costs.

    The searched columns are lower-cased once per row, before the flags look into them.
    """
    lowered = {columns: "_" + "_".join(columns) for ((columns, _),) in FLAGS.values()}
    line_items = line_items.withColumns({short: searched([F.col(c) for c in cs]) for cs, short in lowered.items()})
    derived = {name: holds_any(F.col(lowered[columns]), words) for name, ((columns, words),) in FLAGS.items()}
    derived["usage_hours"] = usage_hours()
    derived |= {c: clean_cost(F.col(c)) for c in COST_COLUMNS if c in line_items.columns}
    return line_items.withColumns(derived).drop(*lowered.values())
