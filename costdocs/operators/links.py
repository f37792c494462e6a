"""Links, topic lists and service mentions of pages, and the page-structure record."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costdocs.functions.markup import FACTS_TYPE, page_facts_udf, topic_links_udf
from costdocs.functions.text import contains_any, first_filled, rows_of
from costdocs.sources.pages import header_map

# Where relative links start, and the word that a kept link holds.
BASE_URL = "https://docs.aws.amazon.com/sagemaker/latest/dg/"
LINK_WORD = "sagemaker"

# The service names looked for in a page.
SERVICES = (
    "Amazon SageMaker Studio",
    "Amazon SageMaker Studio Classic",
    "Amazon SageMaker Notebook Instances",
    "Amazon SageMaker Studio Lab",
    "Amazon SageMaker Canvas",
    "Amazon SageMaker geospatial",
    "RStudio on Amazon SageMaker",
    "SageMaker HyperPod",
    "Amazon SageMaker AutoPilot",
    "Amazon SageMaker Feature Store",
    "Amazon SageMaker Model Monitor",
    "Amazon SageMaker Pipelines",
    "Amazon SageMaker JumpStart",
    "Amazon SageMaker Ground Truth",
    "Amazon SageMaker Data Wrangler",
    "Amazon SageMaker Model Registry",
    "Amazon SageMaker Projects",
    "Amazon SageMaker ML Lineage",
    "Amazon SageMaker Model Building Pipeline",
    "Amazon SageMaker Training Compiler",
    "Amazon SageMaker Inference Recommender",
    "Amazon SageMaker Edge Manager",
    "Amazon SageMaker Neo",
    "Amazon SageMaker Clarify",
    "Amazon SageMaker Debugger",
)

def _without_dot_segments(path: Column) -> Column:
    """``a/./b/../c`` to ``a/c``."""
    def step(done: Column, part: Column) -> Column:
        parent = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return (
            F.when(part == "..", parent)
            .when(part == ".", done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.split(path, "/")
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    return F.concat(F.array_join(kept, "/"), tail)


def absolute_url(href: Column, base: str = BASE_URL) -> Column:
    """A link target seen from the base page."""
    at = urlsplit(base)
    origin = f"{at.scheme}://{at.netloc}"
    folder = at.path[: at.path.rfind("/") + 1] or "/"
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    after = F.regexp_extract(href, r"[?#].*$", 0)
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(folder), path))
    resolved = F.when(rooted.rlike(r"(^|/)\.\.?(/|$)"), _without_dot_segments(rooted)).otherwise(rooted)
    page = F.lit(f"{origin}{at.path}")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit(f"{at.scheme}:"), href))
        .when(path == "", F.concat(page, after))
        .otherwise(F.concat(F.lit(origin), resolved, after))
    )


def matching_links(anchors: Column, word: str = LINK_WORD, base: str = BASE_URL) -> Column:
    """Anchors whose target or text holds the word, as an array of (text, url, href)."""
    hits = F.filter(anchors, lambda x: (x["href"] != "") & contains_any([x["href"], x["text"]], [word]))
    return F.transform(
        hits,
        lambda x: F.struct(x["text"].alias("text"), absolute_url(x["href"], base).alias("url"), x["href"].alias("href")),
    )


def page_links(pages: DataFrame, word: str = LINK_WORD, base: str = BASE_URL) -> DataFrame:
    """One row per matching link of a page."""
    facts = pages.select("page_id", page_facts_udf("links")("html").alias("facts"))
    links = matching_links(F.col("facts.links"), word, base)
    return rows_of(facts, ["page_id"], links, "position", "link").select("page_id", "position", "link.*")


def page_topics(pages: DataFrame, base: str = BASE_URL) -> DataFrame:
    """Links of the first topics box of each page."""
    links = rows_of(pages, ["page_id"], topic_links_udf("html"), "position", "link")
    return links.select("page_id", "position", "link.text", absolute_url(F.col("link.href"), base).alias("url"))


def found_services(low_text: Column, services: Sequence[str] = SERVICES) -> Column:
    """Names of the short fixed list that occur in a lower-case text; no join, no shuffle."""
    names = [F.when(F.contains(low_text, F.lit(name.lower())), F.lit(name)) for name in services]
    return F.array_compact(F.array(*names))


def service_mentions(pages: DataFrame, services: Sequence[str] = SERVICES) -> DataFrame:
    """One row per page and service named in its visible text."""
    text = pages.select("page_id", F.lower(page_facts_udf("text")("html")["text"]).alias("_low"))
    found = rows_of(text, ["page_id"], found_services(F.col("_low"), services), "_at", "service")
    return found.select("page_id", "service")


def page_structures(
    pages: DataFrame, word: str = LINK_WORD, services: Sequence[str] = SERVICES, base: str = BASE_URL
) -> DataFrame:
    """The structure record of every page: title, headings, counts, services, links."""
    facts = F.col("facts")
    parsed = pages.select("page_id", "url", page_facts_udf(*FACTS_TYPE.fieldNames())("html").alias("facts"))
    found = parsed.withColumn("_low", F.lower(facts["text"])).select(
        "page_id",
        "url",
        first_filled(facts["title"], F.lit("Unknown")).alias("title"),
        header_map(facts).alias("headers"),
        matching_links(facts["links"], word, base).alias("sagemaker_links"),
        found_services(F.col("_low"), services).alias("found_services"),
    )
    return found.select(
        "page_id",
        "url",
        "title",
        "headers",
        F.size("sagemaker_links").alias("sagemaker_links_count"),
        F.size("found_services").alias("found_services_count"),
        "found_services",
        "sagemaker_links",
    )
