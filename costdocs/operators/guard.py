"""Read-only checks of SQL texts, as columns over a log and as a gate before running one."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.functions.text import strip_space

# Words that the word guard and the substring guard refuse.
FORBIDDEN_WORDS = (
    "insert", "update", "delete", "create", "alter", "drop", "truncate", "attach", "copy", "pragma",
)
FORBIDDEN_SUBSTRINGS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "GRANT", "REVOKE", "EXECUTE", "CALL",
)
# The substring guard's words that the word guard does not know; run_guarded refuses these as well.
EXTRA_WORDS = ("grant", "revoke", "execute", "call")
# A SELECT may reach Java code through these.
REACHING_WORDS = ("reflect", "java_method", "try_reflect")
# Nodes of a parsed query that read nothing by themselves. Relations, table functions and inner definitions
# are looked at one by one; any other node is refused, such as scripts, files, names that are put
# together when the query runs, and tables of another time.
QUERY_NODES = (
    "Project", "Filter", "Aggregate", "Sort", "Join", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except",
    "Intersect", "SubqueryAlias", "UnresolvedHaving", "WithWindowDefinition", "Window", "Generate", "Pivot", "Unpivot",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "LateralJoin", "Sample", "UnresolvedHint", "OneRowRelation",
    "UnresolvedInlineTable", "LocalRelation",
)
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple")
UNNAMED_EXPRESSIONS = ("ExpressionWithUnresolvedIdentifier",)

# How SQL is recognised, and how it is found in a model's answer.
STARTS_WITH_SELECT = r"(?is)^\s*select\b"
CODE_FENCE = (r"^```json", r"```$")
FIRST_SELECT = r"(?is)select\s+.*?(?:;|$)"

NOT_SELECT = "not a SELECT"
FORBIDDEN = "forbidden keyword"
LATEST_PATH = "data/processed/latest"
LATEST = "latest"
MONTH_FILE = r"(?i)read_parquet\(\s*['\"](?:([^'\"]*)/)?(\w+)\.parquet['\"]\s*\)"


def _word_pattern(words) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _starts_with_select(sql: Column) -> Column:
    return F.coalesce(sql.rlike(STARTS_WITH_SELECT), F.lit(False))


def word_guard(sql: Column, words=FORBIDDEN_WORDS) -> Column:
    """Why a SQL text is refused, or null when it is fine."""
    bare = F.regexp_replace(strip_space(sql), r";+$", "")
    forbidden = bare.rlike("(?isU)" + _word_pattern(words))
    return F.when(~_starts_with_select(bare), NOT_SELECT).when(forbidden, FORBIDDEN)


def substring_guard(sql: Column) -> Column:
    """The stricter guard: any forbidden text anywhere, also inside a column name."""
    upper = F.upper(strip_space(sql))
    hit = F.coalesce(upper.rlike("|".join(FORBIDDEN_SUBSTRINGS)), F.lit(False))
    return F.when(hit, FORBIDDEN).when(~F.coalesce(F.startswith(upper, F.lit("SELECT")), F.lit(False)), NOT_SELECT)


def checked(log: DataFrame, reason: Column, sql: str = "sql") -> DataFrame:
    return log.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def refuse_unsafe(sql: str) -> str:
    """The SQL text without its final semicolon; ValueError when it is not a plain SELECT."""
    bare = sql.strip().rstrip(";").rstrip()
    if not re.match(STARTS_WITH_SELECT, bare):
        raise ValueError(f"{NOT_SELECT}: {sql}")
    if re.search("(?is)" + _word_pattern(FORBIDDEN_WORDS + EXTRA_WORDS + REACHING_WORDS), bare):
        raise ValueError(f"{FORBIDDEN}: {sql}")
    return bare


def extract_sql(model_text: Column) -> Column:
    """The SQL inside a model's answer: the ``sql`` field of its JSON, else its first SELECT.

    Null when there is neither; JSON without the field gives the empty text.
    """
    opening, closing = CODE_FENCE
    bare = F.regexp_replace(strip_space(model_text), opening, "")
    bare = strip_space(F.regexp_replace(bare, closing, ""))
    parsed = F.try_parse_json(bare)
    field = F.coalesce(F.try_variant_get(parsed, "$.sql", "string"), F.lit(""))
    found = strip_space(F.regexp_extract(bare, FIRST_SELECT, 0))
    closed = F.when(found == "", None).when(F.endswith(found, F.lit(";")), found).otherwise(F.concat(found, F.lit(";")))
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    return F.when(is_object, field).otherwise(closed)


def month_paths(sql: Column, base_dir: str) -> Column:
    """The 'latest' folder in a SQL text replaced by a month's folder."""
    return F.replace(sql, F.lit(LATEST_PATH), F.lit(base_dir.rstrip("/").replace("\\", "/")))


def table_views(sql: Column) -> Column:
    """``read_parquet('…/NAME.parquet')`` replaced by the view NAME."""
    return F.regexp_replace(sql, r"(?i)read_parquet\(\s*['\"](?:[^'\"]*/)?([A-Za-z0-9_]+)\.parquet['\"]\s*\)", "$1")


def _bound(sql: str, month: str | None, tables_of: Callable[[str], dict[str, DataFrame]] | None) -> tuple[str, dict[str, dict[str, DataFrame]]]:
    """The text with names instead of files, and the tables of the other months it names.

    A file without a folder, in ``latest`` or in the folder of ``month`` is the given view; one in
    another month's folder is that month's table, under the name ``table_month``.
    """
    others: dict[str, dict[str, DataFrame]] = {}

    def name(match: re.Match) -> str:
        folder, table = match[1], match[2]
        named = (folder or LATEST).replace("\\", "/").rstrip("/").rpartition("/")[2].replace("-", "")
        if named in (LATEST, (month or LATEST).replace("-", "")):
            return table
        if tables_of is None:
            raise ValueError(f"no table in {folder}")
        if named not in others:
            others[named] = tables_of(named)
        if table not in others[named]:
            raise ValueError(f"no table {table} in {folder}")
        return f"{table}_{named}"

    return re.sub(MONTH_FILE, name, sql), others


def _items(sequence) -> list:
    """A Scala sequence as a list."""
    return [sequence.apply(i) for i in range(sequence.size())]


class _Relations:
    """A walk over a parsed text: every node, subquery and inner definition is one that is known to be safe.

    ValueError for a node, relation or function beyond the lists, RuntimeError for a name that is neither
    given nor defined in the text where it is used.
    """

    def __init__(self, spark: SparkSession, text: str, known: set[str]):
        self.text, self.subquery = text, spark._jvm.java.lang.Class.forName(
            "org.apache.spark.sql.catalyst.expressions.SubqueryExpression", True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        )
        self.plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(text), frozenset(known))

    def refuse(self, what: str) -> None:
        raise ValueError(f"{FORBIDDEN}: {what} in {self.text}")

    def plan(self, node, names: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind == "UnresolvedWith":
            # A definition sees those before it, and the given names, but neither itself nor later ones.
            if node.allowRecursion():
                self.refuse("RECURSIVE")
            for definition in _items(node.cteRelations()):
                self.plan(definition._2(), names)
                names = names | {definition._1().lower()}
        elif kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1 or node.isStreaming():
                self.refuse(".".join(parts))
            if parts[0].lower() not in names:
                raise RuntimeError(f"SQL failed: no table {parts[0]}")
        elif kind == "UnresolvedTableValuedFunction":
            name = _items(node.name())
            if len(name) != 1 or name[0].lower() not in TABLE_FUNCTIONS:
                self.refuse(".".join(name))
        elif kind not in QUERY_NODES:
            self.refuse(kind)
        for child in _items(node.children()):
            self.plan(child, names)
        for expression in _items(node.expressions()):
            self.expression(expression, names)

    def expression(self, node, names: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind in UNNAMED_EXPRESSIONS:
            self.refuse("IDENTIFIER")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = _items(node.nameParts()) if kind == "UnresolvedFunction" else [node.name().funcName()]
            if len(name) != 1 or name[0].lower() in REACHING_WORDS:
                self.refuse(".".join(name))
        if self.subquery.isInstance(node):
            self.plan(node.plan(), names)
        for child in _items(node.children()):
            self.expression(child, names)


def run_guarded(
    spark: SparkSession,
    sql: str,
    views: dict[str, DataFrame],
    month: str | None = None,
    tables_of: Callable[[str], dict[str, DataFrame]] | None = None,
) -> DataFrame:
    """Run a SELECT over the given views; ValueError when refused, RuntimeError when it fails.

    ``month`` is the month of the views. Files of other months are looked up by ``tables_of``, which
    raises for a month it does not have. The views are known to this text only: they are registered
    under names of their own, so that calls for other months, and the caller's views, are not touched.
    """
    text, others = _bound(refuse_unsafe(sql), month, tables_of)
    tables = {**views, **{f"{name}_{m}": df for m, of_month in others.items() for name, df in of_month.items()}}
    try:
        _Relations(spark, text, {name.lower() for name in tables})
    except ParseException as error:
        raise RuntimeError(f"SQL failed: {error}") from error
    own = {name: f"guarded_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(own[name])
        given = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in own.items())
        return spark.sql(f"WITH {given} {text}" if given else text)
    except Exception as error:
        raise RuntimeError(f"SQL failed: {error}") from error
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)
