"""The cost mart: the flagged fact table and its ten summaries, stored per month.

The month of the mart is a partition column of its own, ``mart_month``: the tables keep
exactly their columns, and a line item's own ``billing_ym`` stays as it is. Files lie in
``data/version=…/table=…/mart_month=…``; which version a month has is in the manifest, whose newest
record appears by one rename after all is written (:mod:`costdocs.plans.snapshots`). The ten
summaries are one write, so their files also have the columns of the others, without values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.functions.text import megabytes
from costdocs.operators.flags import COST_TYPE, FLAGS, fact
from costdocs.operators.joins import observed
from costdocs.operators.rollups import FACT_TABLE, MEASURE_OF, ROLLUP, ROLLUPS, TABLES, pick, summarise, summarise_all
from costdocs.plans import snapshots
from costdocs.sources.cost import COST_COLUMNS, CUR_SCHEMA
from costdocs.sources.scratch import remove, scratch_path

SCHEMA_VERSION = "1.0"
MONTH = "mart_month"
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder for null
CATEGORY_COLUMNS = ("rule_category", "llm_category")  # in the stored fact table, null unless asked for
STAGED_SUMMARIES = (
    f"key1 string, key2 string, hours double, unblended double, blended double, {MONTH} string, table string"
)
FEW_ROWS = 50_000_000  # line items up to which a summary's month is one file


def build(line_items: DataFrame) -> dict[str, DataFrame]:
    """All eleven tables as plans; every summary reads only the columns it needs."""
    costs = fact(line_items)
    return {FACT_TABLE: costs, **{r.table: summarise(costs, r.table) for r in ROLLUPS}}


def build_single_pass(line_items: DataFrame) -> dict[str, DataFrame]:
    """All eleven tables; the ten summaries come from one scan and one shuffle.

    The rows of :func:`summarise_all` are written to a table in the shared folder first, so
    that ten readers do not scan the line items ten times.
    """
    spark = line_items.sparkSession
    costs = fact(line_items)
    path = scratch_path(spark, "summaries")
    summarise_all(costs).write.partitionBy("table").parquet(path)
    rows = spark.read.schema(STAGED_SUMMARIES).parquet(path)
    return {FACT_TABLE: costs, **{name: pick(rows, name) for name in ROLLUP}}


# ---- stored mart -------------------------------------------------------------------------


def table_schema(table: str) -> T.StructType:
    """Column types of a stored table, the month last."""
    if table == FACT_TABLE:
        fields = [T.StructField(f.name, COST_TYPE) if f.name in COST_COLUMNS else f for f in CUR_SCHEMA.fields]
        fields += [T.StructField(name, T.BooleanType()) for name in FLAGS]
        fields += [T.StructField("usage_hours", T.DoubleType())]
        fields += [T.StructField(name, T.StringType()) for name in CATEGORY_COLUMNS]
    else:
        rollup = ROLLUP[table]
        fields = [T.StructField(name, T.StringType()) for name, _ in rollup.keys]
        fields += [T.StructField(name, T.DoubleType()) for name, _ in rollup.measures]
    return T.StructType([*fields, T.StructField(MONTH, T.StringType())])


def _aligned(df: DataFrame, table: str) -> DataFrame:
    """Known columns in their stored types, then whatever else the line items have; the month last."""
    known = table_schema(table).fields
    names = [f.name for f in known]
    extra = [F.col(c) for c in df.columns if c not in names]
    *typed, month = [F.col(f.name).cast(f.dataType).alias(f.name) for f in known if f.name in df.columns]
    return df.select(*typed, *extra, month)


def _side_by_side(rows: DataFrame) -> DataFrame:
    """The rows of all summaries under their own column names, null where a table has no such column."""
    sources: dict[str, dict[str, list[str]]] = {}
    for rollup in ROLLUPS:
        columns = [(name, f"key{i}") for i, (name, _) in enumerate(rollup.keys, 1)]
        for name, source in [*columns, *((name, MEASURE_OF[column]) for name, column in rollup.measures)]:
            sources.setdefault(name, {}).setdefault(source, []).append(rollup.table)

    def column(name: str) -> Column:
        cases = [F.when(F.col("table").isin(tables), F.col(source)) for source, tables in sources[name].items()]
        return F.coalesce(*cases).alias(name)

    return rows.select(*[column(name) for name in sources], "table", MONTH)


def write_mart(
    spark: SparkSession, line_items: DataFrame, base: str, csv: bool = False, rebalance: bool = True
) -> DataFrame:
    """Write all months of ``line_items`` and publish them as the whole mart, by one rename.

    The fact table is written first and the summaries are made from its written columns, so
    the input is read once. With ``rebalance`` rows are moved together by month: a month that
    holds much of the data is split over several tasks, small ones share a task. Leave it out
    when the input files are laid out by month already; then the fact table needs no shuffle.
    Line items without a month get a partition of their own, which is no month of the mart.
    Months that are not among the line items are no longer part of the mart; see
    :func:`write_month` for a single month. Gives the manifest.
    """
    return _write(spark, line_items, base, None, csv, rebalance)


def write_month(spark: SparkSession, line_items: DataFrame, base: str, month: str, csv: bool = False) -> DataFrame:
    """Write all given line items as one month and leave the others; until all is written, readers see the old month.

    An empty table replaces an older one as well.
    """
    month = month.replace("-", "")
    if not month.isalnum():
        raise ValueError(f"not a month: {month}")
    return _write(spark, line_items, base, month, csv, False)


def _write(
    spark: SparkSession, line_items: DataFrame, base: str, month: str | None, csv: bool, rebalance: bool
) -> DataFrame:
    version = snapshots.new_version()
    folder = snapshots.version_folder(base, version)
    try:
        # Rows are moved as they came: the flags, exact costs and month that are made of them need not ride along.
        laid_out = line_items.hint("rebalance", "billing_ym") if rebalance else line_items
        costs = _aligned(fact(laid_out.withColumn(MONTH, F.col("billing_ym") if month is None else F.lit(month))), FACT_TABLE)
        extra = [f for f in costs.schema.fields if f.name not in table_schema(FACT_TABLE).fieldNames()]
        seen = Observation()
        counted = costs.observe(seen, F.count("*").alias("rows"))
        counted.write.partitionBy(MONTH).parquet(f"{folder}/table={FACT_TABLE}")
        rows = observed(seen).get("rows", 0)
        counts = {FACT_TABLE: rows, **_write_summaries(spark, folder, rows)}
        _write_file_list(spark, base, version, month)
        made = _records(spark, base, version, month, counts, extra)
        if month is None:
            snapshots.publish(spark, base, MANIFEST_SCHEMA, version, lambda _: made)
        else:
            snapshots.publish(spark, base, MANIFEST_SCHEMA, version, lambda old: old.where(~F.col(MONTH).eqNullSafe(month)).unionByName(made))
    except Exception:
        for path in (folder, f"{base}/manifest_files/version={version}"):  # nobody has seen them
            remove(spark, path)
        raise
    if csv:
        _write_csv(spark, base, month)
    return read_manifest(spark, base)


def _write_summaries(spark: SparkSession, folder: str, line_items: int) -> dict[str, int]:
    """All ten summaries of a version in one write; the number of rows of each."""
    stored = spark.read.schema(table_schema(FACT_TABLE)).parquet(f"{folder}/table={FACT_TABLE}")
    rows = summarise_all(stored, by=[MONTH])
    # Few rows make many small files, which tasks share evenly; where there are many, files are split by size.
    few = line_items <= FEW_ROWS
    rows = rows.repartition(max(8, spark.sparkContext.defaultParallelism), "table", MONTH) if few else rows.hint("rebalance", "table", MONTH)
    seen = Observation()
    counted = _side_by_side(rows).observe(seen, *[F.count_if(F.col("table") == name).alias(name) for name in ROLLUP])
    counted.write.mode("append").partitionBy("table", MONTH).parquet(folder)
    return observed(seen)


def _write_csv(spark: SparkSession, base: str, month: str | None) -> None:
    """Copies of the published tables for reading by eye; they are no part of the snapshot."""
    state = Snapshot.load(spark, base)
    for table in TABLES:
        where = f"{base}/csv/{table}" + (f"/{MONTH}={month}" if month else "")
        state.table(table, month, keep_month=True).write.mode("overwrite").csv(where, header=True, quoteAll=True)


# ---- manifest ----------------------------------------------------------------------------

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("row_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("extra_columns", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField(MONTH, T.StringType()),
    ]
)
FILE_TYPE = f"table string, name string, size_bytes long, modified_at timestamp, {MONTH} string"


def _records(
    spark: SparkSession, base: str, version: str, month: str | None, counts: dict[str, int], extra: Sequence[T.StructField]
) -> DataFrame:
    """One record per month: time, schema version, row counts (0 for an empty table), extra columns, version.

    The counts of a single month were taken while it was written, those of several come with the list of files.
    """
    zero = F.map_from_arrays(F.array(*[F.lit(t) for t in TABLES]), F.array(*[F.lit(0).cast("long") for _ in TABLES]))
    if month is not None:
        found = spark.createDataFrame([(month, counts)], f"{MONTH} string, _counts map<string,long>")
    else:
        files = spark.read.schema(f"{FILE_TYPE}, rows long").json(f"{base}/manifest_files/version={version}")
        rows = files.groupBy(MONTH, "table").agg(F.sum("rows").alias("rows"))
        found = rows.groupBy(MONTH).agg(F.map_from_entries(F.collect_list(F.struct("table", "rows"))).alias("_counts"))
    return found.select(
        F.lit(datetime.now(timezone.utc).isoformat()).alias("created_at"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.map_zip_with(zero, F.col("_counts"), lambda _, none, n: F.coalesce(n, none)).alias("row_counts"),
        F.lit(T.StructType(list(extra)).json()).alias("extra_columns"),
        F.lit(version).alias("version"),
        MONTH,
    )


def _listed(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Data files below the folders with size and time of change; only the listing is read, not the files."""
    if not folders:
        return spark.createDataFrame([], f"version string, {FILE_TYPE}")
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(list(folders))
    )
    part = lambda name: F.regexp_extract("path", rf"/{name}=([^/]+)/", 1)
    return listed.select(
        part("version").alias("version"),
        part("table").alias("table"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.nullif(part(MONTH), F.lit(NO_MONTH)).alias(MONTH),
    )


def _write_file_list(spark: SparkSession, base: str, version: str, month: str | None) -> None:
    """The data files of a version as rows of their own, as a month may have many.

    With many months, their rows are counted by the same look at the files: it reads no column, only footers.
    """
    folder = snapshots.version_folder(base, version)
    if month is not None:
        files = _listed(spark, [folder]).drop("version")
    else:
        about = [F.col(f"_metadata.file_{c}").alias(n) for c, n in (("name", "name"), ("size", "size_bytes"), ("modification_time", "modified_at"))]
        rows = spark.read.schema(f"table string, {MONTH} string").parquet(folder).groupBy("table", MONTH, *about)
        files = rows.agg(F.count("*").alias("rows"))
    files.write.json(f"{base}/manifest_files/version={version}")


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    """The newest record, one row per month; none where there is no mart."""
    known = snapshots.records(spark, base)
    return snapshots.rows_of(spark, known[-1][1] if known else None, MANIFEST_SCHEMA)


def read_manifest_files(spark: SparkSession, base: str) -> DataFrame:
    """The data files of the mart as they were listed when they were written."""
    state = Snapshot.load(spark, base)
    if not state.versions:
        return spark.createDataFrame([], FILE_TYPE)
    paths = [f"{base}/manifest_files/version={v}" for v in state.versions]
    rows = spark.read.schema(f"{FILE_TYPE}, version string").option("basePath", f"{base}/manifest_files").json(paths)
    return rows.where(state.current()).drop("version")


# ---- reading -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """The newest record, read once, and the tables that it names."""

    spark: SparkSession
    base: str
    rows: dict[str | None, Row]  # by month

    @classmethod
    def load(cls, spark: SparkSession, base: str) -> Snapshot:
        """One row per month is fetched; a record holds nothing else."""
        return cls(spark, base, {r[MONTH]: r for r in read_manifest(spark, base).collect()})

    @property
    def versions(self) -> dict[str, list[str | None]]:
        """The versions in use and their months."""
        found: dict[str, list[str | None]] = {}
        for month in sorted(self.rows, key=str):
            found.setdefault(self.rows[month]["version"], []).append(month)
        return found

    def current(self) -> Column:
        """Whether a row's version is the one that its month has."""
        if len(self.versions) == 1:  # all of it is in use
            return F.lit(True)
        cases = [
            (F.col("version") == version) & (F.col(MONTH).isin([m for m in months if m is not None]) | (F.col(MONTH).isNull() if None in months else F.lit(False)))
            for version, months in self.versions.items()
        ]
        return reduce(Column.__or__, cases, F.lit(False))

    def extra_columns(self, month: str | None = None) -> list[T.StructField]:
        """The columns that the line items of the months, or of one, brought along.

        A month without such a column holds nulls in it; two types for one name are an error.
        """
        found: dict[str, T.StructField] = {}
        for text in sorted({r["extra_columns"] or "" for m, r in self.rows.items() if month is None or m == month} - {""}):
            for field in T.StructType.fromJson(json.loads(text)).fields:
                if found.setdefault(field.name, field).dataType != field.dataType:
                    raise ValueError(f"{field.name} has two types in the stored months")
        return list(found.values())

    def table(self, table: str, month: str | None = None, keep_month: bool = False) -> DataFrame:
        """A table of one month, read from its folder only; or of all months, with the month."""
        *known, last = table_schema(table).fields
        extra = self.extra_columns(month) if table == FACT_TABLE else []
        schema = T.StructType([*known, *extra, last])
        # An empty table has no folder.
        having = [m for m, r in self.rows.items() if r["row_counts"].get(table) and (month is None or m == month)]
        versions = sorted({self.rows[m]["version"] for m in having})
        folders = [f"{snapshots.version_folder(self.base, v)}/table={table}" for v in versions]
        if month is not None:
            folders = [f"{f}/{MONTH}={month}" for f in folders]
        if folders:
            typed = T.StructType([*schema.fields, T.StructField("version", T.StringType()), T.StructField("table", T.StringType())])
            df = self.spark.read.schema(typed).option("basePath", f"{self.base}/data").parquet(*folders)
            df = df.where(F.col(MONTH) == month) if month is not None else df.where(self.current())
            df = df.select(*schema.fieldNames())
        else:
            df = self.spark.createDataFrame([], schema)
        return df.drop(MONTH) if month is not None and not keep_month else df


def read_table(spark: SparkSession, base: str, table: str, month: str | None = None) -> DataFrame:
    return Snapshot.load(spark, base).table(table, month)


def read_mart(spark: SparkSession, base: str, month: str = "latest") -> dict[str, DataFrame]:
    state = Snapshot.load(spark, base)
    chosen = _resolved(state, month)
    return {table: state.table(table, chosen) for table in TABLES}


def stored_files(spark: SparkSession, base: str, month: str | None = None) -> DataFrame:
    """Data files of the mart with size and time of change, one row per file.

    Only the file listing is read, not the files, and of one month only its folders are listed.
    """
    state = Snapshot.load(spark, base)
    if month is None:
        listed = _listed(spark, [snapshots.version_folder(base, v) for v in state.versions]).where(state.current())
    else:
        row = state.rows.get(month)
        listed = _listed(spark, [f"{snapshots.version_folder(base, row['version'])}/table=*/{MONTH}={month}"] if row and any(row["row_counts"].values()) else [])
    return listed.drop("version")


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.select(MONTH, F.explode("row_counts").alias("table", "rows"))


def months(spark: SparkSession, base: str) -> DataFrame:
    """Months of the mart in order; only the small manifest is read. None when there is no mart."""
    return read_manifest(spark, base).select(MONTH).where(F.col(MONTH).isNotNull()).distinct().orderBy(MONTH)


def _resolved(state: Snapshot, month: str) -> str:
    known = [m for m in state.rows if m is not None]
    found = max(known, default=None) if month == "latest" else month.replace("-", "")
    if found not in known:
        raise FileNotFoundError(f"{state.base} has no month {month}")
    return found


def resolve_month(spark: SparkSession, base: str, month: str = "latest") -> str:
    """The newest month, or the given one; FileNotFoundError when the mart does not have it."""
    return _resolved(Snapshot.load(spark, base), month)


def mart_sizes(spark: SparkSession, base: str, month: str | None = None) -> DataFrame:
    """Megabytes per table and month, rounded to two digits."""
    files = stored_files(spark, base, month)
    return files.groupBy(MONTH, "table").agg(megabytes(F.sum("size_bytes")).alias("size_mb"))


def mart_total_size(spark: SparkSession, base: str, month: str | None = None) -> DataFrame:
    """Megabytes per month, rounded after adding up."""
    files = stored_files(spark, base, month)
    return files.groupBy(MONTH).agg(megabytes(F.sum("size_bytes")).alias("total_size_mb"))


# ---- catalog -----------------------------------------------------------------------------


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Column names and types of the given tables, one row per column."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, i, field.name, field.dataType.simpleString())
        for name, df in tables.items()
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "table string, ordinal int, column string, type string")


def catalog_json(tables: dict[str, DataFrame]) -> str:
    return json.dumps({name: df.columns for name, df in tables.items()}, ensure_ascii=False, indent=2)


def month_info(spark: SparkSession, base: str, month: str = "latest") -> dict:
    """Month, folder, schema and tables that have rows; an error record when the month is missing."""
    try:
        state = Snapshot.load(spark, base)
        chosen = _resolved(state, month)
        filled = sorted(table for table, rows in state.rows[chosen]["row_counts"].items() if rows)
        return {
            "month": chosen,
            "base_dir": base,
            "schema": catalog_json({t: state.table(t, chosen) for t in filled}),
            "source_files": filled,
            "file_count": len(filled),
        }
    except Exception as error:
        return {"month": month, "error": str(error), "schema": None, "source_files": [], "file_count": 0}

