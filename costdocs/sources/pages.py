"""Pages as rows, and the JSON files of page-structure records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.functions.markup import HEADERS_TYPE, LEVELS, page_document_udf
from costdocs.functions.text import first_filled

STRUCTURE_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("headers", HEADERS_TYPE),
        T.StructField("sagemaker_links_count", T.IntegerType()),
        T.StructField("found_services_count", T.IntegerType()),
        T.StructField("found_services", T.ArrayType(T.StringType())),
        T.StructField(
            "sagemaker_links",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("text", T.StringType()),
                        T.StructField("url", T.StringType()),
                        T.StructField("href", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def path_stem(url: Column) -> Column:
    """Last path part of a URL without its last suffix; empty for a bare host."""
    path = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    path = F.regexp_replace(path, r";[^/]*$", "")
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def page_source(url: Column) -> Column:
    """File name of a page: the URL's path stem, or index."""
    return F.concat(first_filled(path_stem(url), F.lit("index")), F.lit(".html"))


def header_map(facts: Column) -> Column:
    return F.create_map(*[x for level in LEVELS for x in (F.lit(level), facts[level])])


def page_documents(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Document rows: url, file name, cleaned html, title and headers of the whole page, load time."""
    df = pages.limit(limit) if limit else pages
    read = df.select("page_id", "url", page_document_udf("html").alias("_facts"))
    return read.select(
        "page_id",
        "url",
        page_source(F.col("url")).alias("source"),
        "_facts.html",
        F.coalesce("_facts.title", F.lit("")).alias("title"),
        header_map(F.col("_facts")).alias("headers"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("scraped_at"),
    )


def write_structures(records: DataFrame, path: str) -> None:
    records.select(*STRUCTURE_SCHEMA.fieldNames()).write.mode("overwrite").json(path)


def read_link_urls(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Distinct non-empty link URLs of page-structure files.

    ``multi_line`` reads files that hold one indented record each.
    """
    records = spark.read.schema(STRUCTURE_SCHEMA).option("multiLine", multi_line).json(path)
    return (
        records.select(F.explode("sagemaker_links.url").alias("url"))
        .where(F.col("url") != "")
        .distinct()
    )
