"""Questions asked of the mart: totals, breakdowns, shares, tags, trends and spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costdocs.operators.classify import OTHER, with_rule_category
from costdocs.operators.flags import FLAGS
from costdocs.operators.rollups import total
from costdocs.sources.cost import TAG_COLUMNS

SERVICE_FLAGS = [name for name in FLAGS if name != "is_spot"]


def month_total(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("billing_ym").agg(total("unblended_cost").alias("cost"))


def endpoint_instances(agg_endpoint_hours: DataFrame) -> DataFrame:
    """Endpoint hours and cost per instance type."""
    return agg_endpoint_hours.groupBy("instance_type").agg(total("hours").alias("hours"), total("cost").alias("cost"))


def notebook_usage(fact: DataFrame) -> DataFrame:
    """Notebook hours and cost per usage type."""
    return (
        fact.where("is_notebook")
        .groupBy(F.col("lineitem_usagetype").alias("usage_type"))
        .agg(total("usage_hours").alias("hours"), total("lineitem_unblendedcost").alias("cost"))
    )


def spot_share(agg_spot_ratio: DataFrame) -> DataFrame:
    """Cost and share per price type; the window runs over the two summary rows."""
    everything = F.sum("cost").over(Window.partitionBy())
    return agg_spot_ratio.withColumn("share", F.when(everything != 0, F.col("cost") / everything))


def costliest_training(agg_training_cost: DataFrame, top: int = 10) -> DataFrame:
    return agg_training_cost.orderBy(
        F.desc("cost"), F.asc_nulls_first("account_id"), F.asc_nulls_first("instance_type")
    ).limit(top)


def idle_endpoints(fact: DataFrame, max_hours: float) -> DataFrame:
    """Endpoint resources with few hours: candidates for a cheaper way to serve.

    The hours are summed per (resource, instance) first, so that a busy resource is merged
    inside the map tasks and its instances are counted without a second wide shuffle.
    """
    per_instance = (
        fact.where(F.col("is_endpoint") & F.col("lineitem_resourceid").isNotNull())
        .groupBy(F.col("lineitem_resourceid").alias("resource_id"), "product_instancetype")
        .agg(total("usage_hours").alias("hours"), F.sum("lineitem_unblendedcost").alias("cost"))
    )
    return (
        per_instance.groupBy("resource_id")
        .agg(total("hours").alias("hours"), total("cost").alias("cost"), F.count("product_instancetype").alias("instances"))
        .where(F.col("hours") < max_hours)
    )


def untagged() -> Column:
    """True when none of the ten tags is filled."""
    tags = F.array(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in TAG_COLUMNS])
    return F.size(F.array_compact(tags)) == 0


def tag_missing_rate(fact: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Share of empty tags per account, for each tag and for all ten together."""
    def empty(c: str) -> Column:
        return (F.coalesce(F.trim(F.col(c)), F.lit("")) == "").cast("int")

    return fact.groupBy(F.col("lineitem_usageaccountid").alias("account_id")).agg(
        F.count("*").alias("line_items"),
        F.avg(untagged().cast("int")).alias("untagged_rate"),
        *[F.avg(empty(c)).alias(f"{c}_missing") for c in tags or TAG_COLUMNS],
    )


def uncategorised_cost(fact: DataFrame) -> DataFrame:
    """Cost per account without a category."""
    return (
        with_rule_category(fact, "_category")
        .where(F.col("_category") == OTHER)
        .groupBy(F.col("lineitem_usageaccountid").alias("account_id"))
        .agg(total("lineitem_unblendedcost").alias("cost"))
    )


def _in_month_order() -> Window:
    return Window.partitionBy().orderBy("billing_ym")


def trend(monthly: DataFrame, factor: float = 1.5) -> DataFrame:
    """Cost of each month, the change to the month before and the mean of the three before.

    ``monthly`` has one row per month, so the window runs over a few hundred rows at most.
    """
    order = _in_month_order()
    before = F.avg("unblended_cost").over(order.rowsBetween(-3, -1))
    last = F.lag("unblended_cost").over(order)
    return monthly.select(
        "billing_ym",
        F.col("unblended_cost").alias("cost"),
        (F.col("unblended_cost") - last).alias("change"),
        before.alias("mean_before"),
        F.coalesce(F.col("unblended_cost") > F.lit(factor) * before, F.lit(False)).alias("is_spike"),
    )


def last_months(trend_rows: DataFrame, n: int = 3) -> DataFrame:
    return trend_rows.orderBy(F.desc("billing_ym")).limit(n)


def spike_causes(fact: DataFrame) -> DataFrame:
    """Cost change per rule category to the month before, the months summed up first."""
    monthly = (
        with_rule_category(fact.where(F.col("billing_ym").isNotNull()), "category")
        .groupBy("billing_ym", "category")
        .agg(total("lineitem_unblendedcost").alias("cost"))
    )
    order = Window.partitionBy("category").orderBy("billing_ym")
    return monthly.withColumn("change", F.col("cost") - F.lag("cost").over(order))


def service_costs(fact: DataFrame) -> DataFrame:
    """Cost per kind of use in one pass; a line item counts in every kind whose flag it has."""
    sums = fact.agg(
        *[
            F.coalesce(F.sum(F.when(F.col(f), F.col("lineitem_unblendedcost"))).cast("double"), F.lit(0.0)).alias(f)
            for f in SERVICE_FLAGS
        ],
        *[F.count_if(F.col(f)).alias(f"{f}_n") for f in SERVICE_FLAGS],
    )
    rows = [
        F.struct(F.lit(f[3:]).alias("service"), F.col(f).alias("cost"), F.col(f"{f}_n").alias("line_items"))
        for f in SERVICE_FLAGS
    ]
    return sums.select(F.inline(F.array(*rows)))


def costliest_service(fact: DataFrame) -> DataFrame:
    return service_costs(fact).orderBy(F.desc("cost"), "service").limit(1)
