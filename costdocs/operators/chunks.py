"""Pages to sections to chunks, and the metadata of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costdocs.functions.markup import LEVELS, page_parts_udf
from costdocs.functions.splitter import split_column, step_column, window_column
from costdocs.functions.text import first_filled, rows_of, title_case

# What stands in for a missing URL or section.
DEFAULT_URL = "https://docs.aws.amazon.com/sagemaker/"
DEFAULT_SECTION = "General"


def sections(documents: DataFrame) -> DataFrame:
    """Text of each page cut at H1 to H3, without boilerplate and repeated lines.

    Every section carries the first H1, H2 and H3 of its page, and its own header. Needs
    ``source``, ``url`` and ``html``; other columns are carried along. The page is parsed
    once and only its parts come back from Python.
    """
    carried = [c for c in documents.columns if c not in ("html", "headers", "scraped_at")]
    parts = F.col("_parts")
    firsts = F.create_map(*[x for level in LEVELS for x in (F.lit(level), parts[level])])
    return (
        documents.select(*carried, page_parts_udf("html").alias("_parts"))
        .select(
            *carried,
            F.map_filter(firsts, lambda _, text: text != "").alias("section_headers"),
            parts["title_tag"].alias("title_tag"),
            F.explode_outer(parts["sections"]).alias("_section"),
        )
        .where(F.col("_section").isNotNull())
        .select(*carried, "section_headers", "title_tag", "_section.*")
    )


def chunk_id(stem: Column, section_order: Column, chunk_order: Column) -> Column:
    return F.format_string("%s#s%02d#%04d", stem, section_order, chunk_order)


def source_stem() -> Column:
    return F.regexp_replace("source", r"^(.+)\.[^.]+$", "$1")


def chunk(sections: DataFrame, size: int = 1200, overlap: int = 120) -> DataFrame:
    """Overlapping chunks of every section; the section text itself is not carried along."""
    carried = [c for c in sections.columns if c != "content"]
    split = sections.select(*carried, split_column(F.col("content"), size, overlap).alias("_chunks"))
    rows = split.select(*carried, F.posexplode("_chunks").alias("chunk_order", "content"))
    return rows.withColumn(
        "id", chunk_id(source_stem(), F.col("section_order"), F.col("chunk_order"))
    ).withColumn("chunk_id", F.col("id"))


def recursive_chunks(texts: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 120) -> DataFrame:
    """Chunks of any text table as rows (key, chunk_order, content)."""
    split = texts.select(key, split_column(F.col(text), size, overlap).alias("_chunks"))
    return split.select(key, F.posexplode("_chunks").alias("chunk_order", "content"))


def window_chunks(texts: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 120) -> DataFrame:
    """Fixed windows of any text table as rows (key, chunk_order, content); blank ones are left out.

    The steps are a column of their own, so that the text is cut once.
    """
    steps = texts.select(key, F.length(text).alias("_length"), step_column(F.col(text), size, overlap).alias("_steps"))
    windows = window_column(F.col("_steps"), F.col("_length"), size, overlap)
    dense = F.filter(windows, lambda x: x != "")
    return rows_of(steps, [key], dense, "chunk_order", "content")


def attach_metadata(chunks: DataFrame, version_date: str, doc_type: str = "developer-guide") -> DataFrame:
    """Version, type, order, title, section and URL of every chunk.

    Needs ``section_headers`` (map from level to text), ``title_tag``, ``source``, ``url`` and
    ``chunk_order``; a ``title`` column is used when there is one.
    """
    headers = F.col("section_headers")
    titles = [F.col(c) for c in ("title_tag", "title") if c in chunks.columns]
    return chunks.withColumns(
        {
            "version_date": F.lit(version_date),
            "doc_type": F.lit(doc_type),
            "order": F.col("chunk_order"),
            "title": first_filled(
                F.try_element_at(headers, F.lit("H1")),
                *titles,
                title_case(source_stem()),
            ),
            "section": first_filled(
                F.try_element_at(headers, F.lit("H2")),
                F.try_element_at(headers, F.lit("H3")),
                F.lit(DEFAULT_SECTION),
            ),
            "url": F.coalesce("url", F.lit(DEFAULT_URL)),
        }
    )


def flat_metadata(df: DataFrame) -> DataFrame:
    """Metadata as plain values: maps and structs as JSON text, null text as ''."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        c = F.col(field.name)
        if kind in ("map", "struct", "array"):
            out.append(F.coalesce(F.to_json(c), F.lit("")).alias(field.name))
        elif kind == "string":
            out.append(F.coalesce(c, F.lit("")).alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


def chunk_manifest(chunks: DataFrame, version_date: str, doc_type: str = "developer-guide") -> DataFrame:
    """Documents and chunks, counted before any chunk is dropped as a copy."""
    return chunks.agg(
        F.countDistinct("source").alias("num_docs"), F.count("*").alias("num_chunks")
    ).select(F.lit(doc_type).alias("doc_type"), F.lit(version_date).alias("version_date"), "num_docs", "num_chunks")
