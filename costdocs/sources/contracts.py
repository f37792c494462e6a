"""Contracts: which accounts belong to which customer agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.operators.joins import MAX_LOOKUP_ROWS, lookup_join

CONTRACT_TYPE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("accounts", T.ArrayType(T.StringType())),
        T.StructField("billing_owner", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
FILE_TYPE = T.StructType(
    [
        T.StructField("contracts", T.MapType(T.StringType(), CONTRACT_TYPE)),
        T.StructField("default_contract", T.StringType()),
    ]
)
EMPTY_SUMMARY = T.StructType(
    [T.StructField("contract_id", T.StringType()), *CONTRACT_TYPE.fields, T.StructField("is_default", T.BooleanType())]
)


def parse_contracts(text: DataFrame) -> DataFrame:
    """One row per contract from a column ``value`` of contract-file texts."""
    parsed = text.select(F.from_json("value", FILE_TYPE).alias("file"))
    return parsed.select(
        F.explode("file.contracts").alias("contract_id", "contract"),
        F.col("file.default_contract").alias("default_contract"),
    ).select(
        "contract_id",
        "contract.*",
        F.coalesce(F.col("contract_id") == F.col("default_contract"), F.lit(False)).alias("is_default"),
    )


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of a JSON file; a missing file gives no contracts."""
    try:
        return parse_contracts(spark.read.text(path, wholetext=True))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EMPTY_SUMMARY)


def contract_summary(contracts: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return contracts.select(
        "contract_id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "description", "billing_owner")],
        F.coalesce(F.size("accounts"), F.lit(0)).alias("account_count"),
        F.coalesce("accounts", empty).alias("accounts"),
        F.coalesce("tags", empty).alias("tags"),
    )


def is_valid(accounts: Column) -> Column:
    return F.coalesce(F.size(accounts), F.lit(0)) > 0


def contract_validity(contracts: DataFrame, asked: DataFrame) -> DataFrame:
    """``valid`` per asked ``contract_id``: false when unknown or without accounts."""
    known = contracts.select("contract_id", is_valid(F.col("accounts")).alias("valid"))
    return asked.join(known, "contract_id", "left").select(
        "contract_id", F.coalesce("valid", F.lit(False)).alias("valid")
    )


def contract_accounts(contracts: DataFrame, contract_id: str | None = None) -> DataFrame:
    """The accounts of one contract, or of the default contract."""
    chosen = F.col("is_default") if contract_id is None else F.col("contract_id") == contract_id
    return contracts.where(chosen).select(F.explode("accounts").alias("account_id")).distinct()


def keep_accounts(cost: DataFrame, accounts: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Line items of the given ``account_id`` rows."""
    wanted = accounts.select(F.col("account_id").alias("lineitem_usageaccountid"))
    kept = lookup_join(cost, wanted, ["lineitem_usageaccountid"], "left_semi", max_rows)
    return kept.select(*cost.columns)


def choose_line_items(
    cost: DataFrame,
    contracts: DataFrame | None = None,
    contract_id: str | None = None,
    account_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Line items of a contract, of an account list, or of the default contract."""
    if contract_id and account_ids:
        raise ValueError("give a contract or accounts, not both")
    if account_ids:
        return cost.where(F.col("lineitem_usageaccountid").isin([a.strip() for a in account_ids if a.strip()]))
    if contracts is None:
        raise ValueError("accounts or contracts are needed")
    accounts = contract_accounts(contracts, contract_id)
    if accounts.isEmpty():
        raise ValueError(f"contract {contract_id or '(default)'} is unknown or has no accounts")
    return keep_accounts(cost, accounts)
