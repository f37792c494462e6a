"""Column helpers for text: keyword rules, fallbacks, cleaning. All run JVM-side."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tag pattern, and entities in the order they are replaced ("&amp;lt;" ends up as "<").
TAG = r"<[^>]+>"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Stands between columns that are searched as one text; no keyword holds it.
BETWEEN = "\x01"

Rules = Sequence[tuple[str, Sequence[str]]]


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def searched(columns: Column | Sequence[Column]) -> Column:
    """One lower-case text to look keywords up in; nulls are left out."""
    return F.lower(F.concat_ws(BETWEEN, *([columns] if isinstance(columns, Column) else columns)))


def holds_any(text: Column, words: Sequence[str]) -> Column:
    return any_of(F.contains(text, F.lit(w.lower())) for w in words)


def contains_any(columns: Column | Sequence[Column], words: Sequence[str]) -> Column:
    """True when any column holds any word, ignoring case; null counts as no match."""
    return holds_any(searched(columns), words)


def _first_rule(text: Column, rules: Rules, default: str) -> Column:
    (label, words), *rest = rules
    out = F.when(holds_any(text, words), F.lit(label))
    for label, words in rest:
        out = out.when(holds_any(text, words), F.lit(label))
    return out.otherwise(F.lit(default))


def first_match(columns: Column | Sequence[Column], rules: Rules, default: str) -> Column:
    """The label of the first rule with a keyword hit, as one CASE WHEN."""
    return _first_rule(searched(columns), rules, default)


def with_first_match(df: DataFrame, name: str, columns: Sequence[Column], rules: Rules, default: str) -> DataFrame:
    """:func:`first_match` as a new column; the text is lower-cased once per row, not per rule."""
    return (
        df.withColumn("_searched", searched(columns))
        .withColumn(name, _first_rule(F.col("_searched"), rules, default))
        .drop("_searched")
    )


def rows_of(df: DataFrame, keep: Sequence[str], array: Column, position: str, element: str) -> DataFrame:
    """One row per array element, with its position.

    The outer form comes without the filter for which Spark would compute the array twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, element))
    return rows.where(F.col(position).isNotNull())


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def normalise_month(c: Column) -> Column:
    """``YYYY-MM`` to ``YYYYMM``; other text passes through."""
    return F.replace(c, F.lit("-"), F.lit(""))


def parse_accounts(c: Column) -> Column:
    """Comma-separated account ids to an array without blanks."""
    return F.filter(F.transform(F.split(c, ","), lambda x: strip_space(x)), lambda x: x != "")


def truncate(c: Column, limit: int, suffix: str) -> Column:
    """Text over ``limit`` characters is cut there and the suffix is added."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(suffix))).otherwise(c)


def strip_space(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(c, F.lit(WHITE_SPACE))


def strip_tags(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, TAG, by)


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def distinct_lines(c: Column) -> Column:
    """Trimmed, non-blank lines of a text, each kept once at its first place."""
    lines = F.transform(F.split(c, r"\R"), lambda x: strip_space(x))
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")


def title_case(c: Column) -> Column:
    """A file stem as a title: dashes and underscores become blanks, words are capitalised."""
    return F.initcap(F.translate(c, "-_", "  "))


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1024 * 1024), 2)
