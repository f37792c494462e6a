"""Reading billing line items: Parquet, JDBC and CSV, with the extraction filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.operators.ranking import first_rows
from costdocs.sources.scratch import scratch_table

# The columns of a billing line item, in order, and what is extracted.
TAG_COLUMNS = [f"usertag{i}" for i in range(10)]
COST_COLUMNS = ["lineitem_unblendedcost", "lineitem_blendedcost"]

# Costs stay text until they are coerced, so that an unreadable value cannot fail the read.
CUR_TYPES = {
    "bill_billingperiodstartdate": "date",
    "bill_billingperiodenddate": "date",
    "billing_ym": "string",
    "lineitem_usageaccountid": "string",
    "lineitem_resourceid": "string",
    "lineitem_usageamount": "double",
    "lineitem_unblendedcost": "string",
    "lineitem_blendedcost": "string",
    "lineitem_currencycode": "string",
    "lineitem_productcode": "string",
    "lineitem_usagetype": "string",
    "lineitem_operation": "string",
    "lineitem_lineitemtype": "string",
    "product_productname": "string",
    "product_instancetype": "string",
    "product_instancetypefamily": "string",
    "product_region": "string",
    "pricing_unit": "string",
    "pricing_term": "string",
    "usertag0": "string",
    "usertag1": "string",
    "usertag2": "string",
    "usertag3": "string",
    "usertag4": "string",
    "usertag5": "string",
    "usertag6": "string",
    "usertag7": "string",
    "usertag8": "string",
    "usertag9": "string",
}
_KINDS = {"date": T.DateType(), "string": T.StringType(), "double": T.DoubleType()}
CUR_SCHEMA = T.StructType([T.StructField(c, _KINDS[t]) for c, t in CUR_TYPES.items()])
CUR_COLUMNS = CUR_SCHEMA.fieldNames()

SNAPSHOT = "sagemaker_cur"
LINE_ITEM_TYPE = "Usage"
PRODUCT_WORD = "SageMaker"


def month_filter(df: DataFrame, months: Sequence[str]) -> DataFrame:
    return df.where(F.col("billing_ym").isin([m.replace("-", "") for m in months]))


def account_filter(df: DataFrame, accounts: Sequence[str]) -> DataFrame:
    return df.where(F.col("lineitem_usageaccountid").isin([a.strip() for a in accounts if a.strip()]))


def usage_filter(df: DataFrame) -> DataFrame:
    return df.where(F.col("lineitem_lineitemtype") == LINE_ITEM_TYPE)


def product_filter(df: DataFrame, word: str = PRODUCT_WORD) -> DataFrame:
    """Case-sensitive, unlike the usage flags."""
    return df.where(F.contains(F.col("product_productname"), F.lit(word)))


def extract(
    table: DataFrame,
    months: Sequence[str] | None = None,
    accounts: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The 29 columns of the line items that pass the four filters."""
    df = product_filter(usage_filter(table))
    if months is not None:
        df = month_filter(df, months)
    if accounts is not None:
        df = account_filter(df, accounts)
    df = df.select(*CUR_COLUMNS)
    return df.limit(limit) if limit else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def month_predicates(months: Sequence[str], account_digits: bool = True) -> list[str]:
    """WHERE clauses that split a warehouse read: by month and by last digit of the account."""
    clauses = []
    for month in months:
        ym = month.replace("-", "")
        if not ym.isalnum():
            raise ValueError(f"not a month: {month}")
        clause = f"billing_ym = '{ym}'"
        if not account_digits:
            clauses.append(clause)
            continue
        digits = [f"lineitem_usageaccountid LIKE '%{d}'" for d in range(10)]
        clauses += [f"{clause} AND {d}" for d in digits]
        clauses.append(f"{clause} AND NOT ({' OR '.join(digits)})")
    return clauses


READ_KEYS = ("lineitem_usageaccountid", "lineitem_resourceid")


def read_cuts(known: DataFrame, parts: int, keys: Sequence[str] = READ_KEYS) -> list[tuple[str, ...]]:
    """At most ``parts - 1`` places in the order of the keys that cut the known rows into equal parts.

    ``known`` is what is known of the table, such as last month's snapshot or its counts by key. Rows are
    counted per key in the map tasks and added up over ranges of the order, so that an account, or any
    number of keys, may hold most rows; only the cuts are fetched. Null counts as the empty text.
    """
    if parts < 1:
        raise ValueError("a table is read in one part or more")
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    with scratch_table(known.sparkSession, "read-keys") as path:
        counts = known.groupBy(*filled).agg(F.count("*").alias("n"))
        counts.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
        rows = known.sparkSession.read.parquet(path).withColumn("part", F.shiftright("place", 33))
        sums = rows.groupBy("part").agg(F.sum("n").alias("n"), F.max_by("n", "place").alias("last")).orderBy("part").collect()  # one row per range
        if not sums:
            return []
        total, first, last_begin, offsets, lasts = sum(r["n"] for r in sums), 0, -1, [], []
        for r in sums:
            offsets += [F.lit(r["part"]), F.lit(first)]
            lasts += [F.lit(r["part"]), F.lit(last_begin)]
            first += r["n"]
            last_begin = first - r["last"]
        earlier = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        begin = F.element_at(F.create_map(*offsets), F.col("part")) + F.coalesce(F.sum("n").over(earlier), F.lit(0))
        placed = rows.withColumn("begin", begin)
        # A key is a cut where a part's share of all rows is reached or passed with the key before it.
        share = lambda at: F.floor(at * parts / total)
        last = F.coalesce(F.lag("begin").over(Window.partitionBy("part").orderBy("place")), F.element_at(F.create_map(*lasts), F.col("part")))
        passed = placed.withColumn("passed", (F.col("begin") > 0) & (share(F.col("begin")) > share(last)))
        # Literals with a backslash are not read alike everywhere; the text before it is as good a cut.
        return sorted({tuple(r[n].split("\\")[0] for n in names) for r in passed.where("passed").select(*names).collect()})


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _from(cut: Sequence[str], keys: Sequence[str]) -> str:
    """The condition that a row is at the cut or after it in the order of the keys."""
    key, *finer = [f"COALESCE({k}, '')" for k in keys]
    if not finer:
        return f"{key} >= {_text(cut[0])}"
    return f"({key} > {_text(cut[0])} OR ({key} = {_text(cut[0])} AND {_from(cut[1:], keys[1:])}))"


def range_predicates(cuts: Sequence[Sequence[str]], months: Sequence[str] = (), keys: Sequence[str] = READ_KEYS) -> list[str]:
    """WHERE clauses, disjoint and complete, that read a table in the parts between the cuts; by month where given.

    Complete whatever the warehouse's order of texts; disjoint where that is the order of code points.
    """
    edges = [_from(cut, keys) for cut in cuts]
    ranges = [" AND ".join(([low] if low else []) + ([f"NOT {high}"] if high else [])) for low, high in zip([None, *edges], [*edges, None])]
    of_month = month_predicates(months, account_digits=False) or [""]
    return [" AND ".join(x for x in (m, r) if x) or "1 = 1" for m in of_month for r in ranges]


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """A warehouse table, one read task per predicate; they must be disjoint and complete.

    Columns and the equality filters of :func:`extract` become part of the remote query. Parts of equal
    size come from :func:`read_cuts` over what is known of the table and :func:`range_predicates`, also
    where one account holds much of a month; :func:`month_predicates` needs no knowledge of it.
    """
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(properties))
    return spark.read.jdbc(url, table, properties=dict(properties))


def read_csv(
    spark: SparkSession,
    path: str,
    apply_filters: bool = False,
    months: Sequence[str] | None = None,
    accounts: Sequence[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV files with a header line, in any column order; by default no filter is applied.

    Nothing is inferred: account and month keep their leading zeros, costs stay text.
    """
    text = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    types = {f.name: f.dataType for f in CUR_SCHEMA.fields}
    df = text.select(*[F.col(c).try_cast(types.get(c, T.StringType())).alias(c) for c in text.columns])
    return extract(df, months, accounts) if apply_filters else df


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv_sample(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The first rows in column order, so that a rerun gives the same sample."""
    order = [F.col(c).asc_nulls_first() for c in df.columns]
    return first_rows(df, rows, order, rank="_place").orderBy("_place").drop("_place")


def write_csv_sample(df: DataFrame, path: str, rows: int = 1000) -> None:
    csv_sample(df, rows).coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True)
