"""Title and H1 to H3 of pages, boilerplate removal and plain text, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costdocs.functions.markup import LEVELS
from costdocs.functions.text import decode_entities, distinct_lines, rows_of, strip_space, strip_tags

# Tags cut out as a whole, and the patterns of title, headings and tags.
BOILERPLATE_TAGS = ("header", "footer", "nav", "aside", "script", "style")
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<{0}[^>]*>(.*?)</{0}>"


def title_tag(html: Column) -> Column:
    """The text of the first title element, null without one."""
    return F.when(html.rlike(TITLE), strip_space(F.regexp_extract(html, TITLE, 1)))


def heading_texts(html: Column, level: str) -> Column:
    """Texts of all headings of a level without inner tags."""
    found = F.regexp_extract_all(html, F.lit(HEADING.format(level.lower())), F.lit(1))
    return F.transform(found, lambda x: strip_space(strip_tags(x)))


def _numbered(texts: Column, level: str) -> Column:
    return F.transform(
        texts, lambda text, i: F.struct(F.lit(level).alias("level"), i.alias("position"), text.alias("text"))
    )


def page_headings(pages: DataFrame) -> DataFrame:
    """One row per heading: page, level, position, text."""
    found = F.concat(*[_numbered(heading_texts(F.col("html"), level), level) for level in LEVELS])
    return rows_of(pages, ["page_id"], found, "_at", "heading").select("page_id", "heading.*")


def heading_counts(pages: DataFrame) -> DataFrame:
    """How many headings of each level every page has."""
    return pages.select(
        "page_id",
        *[F.size(heading_texts(F.col("html"), level)).alias(f"{level.lower()}_count") for level in LEVELS],
    )


def drop_boilerplate(html: Column) -> Column:
    """Whole boilerplate elements cut out by pattern; right where a tag does not nest in itself."""
    for tag in BOILERPLATE_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return html


def plain_text(html: Column, normalise=None) -> Column:
    """Tags cut out, entities decoded, lines trimmed and kept once each.

    ``normalise`` is applied to the text before its lines are compared (Unicode NFKC in the
    page pipeline).
    """
    text = decode_entities(strip_tags(html))
    return distinct_lines(normalise(text) if normalise else text)
