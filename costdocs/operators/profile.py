"""Profile of a query result: numbers per numeric column, size, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE_TYPE = "column string, sum double, mean double, min double, max double"


def _value(name: str, kind: T.DataType) -> Column:
    """A column's numbers; NaN is no value."""
    column = F.col(f"`{name}`")
    return F.nanvl(column, F.lit(None).cast(kind)) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else column


def _sum(column: Column, kind: T.DataType) -> Column:
    """Whole numbers are added up as decimals, which do not overflow."""
    return F.sum(column.cast("decimal(20,0)") if isinstance(kind, T.IntegralType) else column)


def _numbers(df: DataFrame) -> list[Column]:
    out = []
    for i, field in enumerate(f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)):
        column = _value(field.name, field.dataType)
        numbers = {
            "sum": _sum(column, field.dataType),
            "mean": F.avg(column),
            "min": F.min(column),
            "max": F.max(column),
        }
        parts = [F.coalesce(n.cast("double"), F.lit(0.0)).alias(label) for label, n in numbers.items()]
        out.append(F.struct(F.lit(field.name).alias("column"), *parts).alias(f"_{i}"))
    return out


def numeric_profile(df: DataFrame) -> DataFrame:
    """Sum, mean, min and max of every numeric column, 0.0 when there are no values; one pass."""
    numbers = _numbers(df)
    if not numbers:
        return df.sparkSession.createDataFrame([], PROFILE_TYPE)
    return df.agg(*numbers).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(numbers))])))


def result_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def summary(df: DataFrame) -> dict:
    """Row count and numbers of a result, collected as one row from one pass."""
    row = df.agg(F.count("*").alias("row_count"), *_numbers(df)).first()
    numbers = [part.asDict() for part in row[1:]]
    return {
        "row_count": row["row_count"],
        "column_count": len(df.columns),
        "numeric_summary": {n.pop("column"): n for n in numbers},
    }
