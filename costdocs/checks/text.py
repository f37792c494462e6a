"""Registered queries over pages and documents."""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costdocs.checks.fixtures import table
from costdocs.checks.registry import ORACLES, register, written_once
from costdocs.functions.markup import nfkc_udf, page_markup_udf, page_text_udf
from costdocs.functions.text import decode_entities, distinct_lines, megabytes, strip_tags, title_case
from costdocs.operators import chunks, dedup, headings, links, search
from costdocs.plans import chunk_index
from costdocs.sources import pages as page_source

VERSION = "2025-08-01"
LINK_WORD = "the"
NAMES = [*links.SERVICES, "MIT License", "the of", "de la", "der", "que"]
# The twin's own list of what is looked for.
NAMES_SQL = """('Amazon SageMaker Studio'), ('Amazon SageMaker Studio Classic'), ('Amazon SageMaker Notebook Instances'),
 ('Amazon SageMaker Studio Lab'), ('Amazon SageMaker Canvas'), ('Amazon SageMaker geospatial'), ('RStudio on Amazon SageMaker'),
 ('SageMaker HyperPod'), ('Amazon SageMaker AutoPilot'), ('Amazon SageMaker Feature Store'), ('Amazon SageMaker Model Monitor'),
 ('Amazon SageMaker Pipelines'), ('Amazon SageMaker JumpStart'), ('Amazon SageMaker Ground Truth'), ('Amazon SageMaker Data Wrangler'),
 ('Amazon SageMaker Model Registry'), ('Amazon SageMaker Projects'), ('Amazon SageMaker ML Lineage'),
 ('Amazon SageMaker Model Building Pipeline'), ('Amazon SageMaker Training Compiler'), ('Amazon SageMaker Inference Recommender'),
 ('Amazon SageMaker Edge Manager'), ('Amazon SageMaker Neo'), ('Amazon SageMaker Clarify'), ('Amazon SageMaker Debugger'),
 ('MIT License'), ('the of'), ('de la'), ('der'), ('que')"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


# Pages with headings of all levels: the footer becomes an H2, list items H3. SQL knows few entities.
_TAGS = (("<footer>", "<h2>"), ("</footer>", "</h2>"), ("<li>", "<h3>"), ("</li>", "</h3>"), ("&copy;", "©"), ("&middot;", "·"))
TAGGED_SQL = "html"
for _old, _new in _TAGS:
    TAGGED_SQL = f"replace({TAGGED_SQL}, '{_old}', '{_new}')"
_FOUND = "array_to_string([trim({0}, {1}) for h in regexp_extract_all(t, '(?is)<h{2}[^>]*>(.*?)</h{2}>', 1)], '|')"


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).withColumn("html", F.expr(TAGGED_SQL))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_TAGLESS = "regexp_replace({0}, '<[^>]+>', '', 'g')"
_ENTITIES = "replace(replace(replace(replace({0}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
# What a browser shows: every entity is decoded once, so the ampersand comes last.
_SHOWN = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(13)"
_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), ';[^/]*$', '')"
STEM_SQL = f"coalesce(nullif(regexp_replace(regexp_extract({_PATH}, '([^/]*)/*$', 1), '^(.+)\\.[^.]+$', '\\1'), ''), 'index')"
TITLE_SQL = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
H1_SQL = "regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"


def _without(html: str, *tags: str) -> str:
    for tag in tags:
        html = f"regexp_replace({html}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
    return html


def _lines_sql(source: str, key: str, text: str) -> str:
    """One text per key: trimmed, non-blank lines, each at its first place."""
    return f"""SELECT {key}, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
 SELECT {key}, trim(line, {_SPACE}) AS line, min(pos) AS pos FROM (
  SELECT {key}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS pos FROM {source})
 WHERE trim(line, {_SPACE}) <> '' GROUP BY 1, 2) GROUP BY 1"""


# ---- page rows ---------------------------------------------------------------------------


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_source.page_documents(tagged_pages(spark, sf_dir))
    return rows.select(
        "page_id", "url", "source", "title", *[F.concat_ws("|", F.col("headers")[f"H{i}"]).alias(f"h{i}") for i in (1, 2, 3)], *markup_content()
    )


def markup_content() -> list[Column]:
    """The tags that a page's markup opens, in order, and the text between them; ends of tags may be added."""
    text = strip_tags(F.regexp_replace("html", r"(?s)<!--.*?-->", ""))
    for entity, char in (("&quot;", '"'), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    tags = F.array_join(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1)), ",")
    return [tags.alias("tags"), F.md5(text).alias("text_md5")]


def _content_sql(html: str) -> str:
    clean = _without(html, "script", "style", "nav", "footer", "aside")
    text = _SHOWN.format(_TAGLESS.format(f"regexp_replace({clean}, '(?s)<!--.*?-->', '', 'g')"))
    return f"array_to_string(regexp_extract_all({clean}, '<([a-z][a-z0-9]*)', 1), ',') AS tags, md5({text}) AS text_md5"


register(
    "a12_page_load",
    loaded,
    f"""SELECT page_id, url, concat({STEM_SQL}, '.html') AS source, trim({_SHOWN.format(TITLE_SQL)}, {_SPACE}) AS title,
 {', '.join(f"{_FOUND.format(_SHOWN.format(_TAGLESS.format('h')), _SPACE, i)} AS h{i}" for i in (1, 2, 3))}, {_content_sql('t')}
 FROM (SELECT *, {TAGGED_SQL} AS t FROM pages)""",
)
register(
    "i01_plain_text",
    lambda s, d: pages(s, d).select("page_id", headings.plain_text(F.col("html"), nfkc_udf).alias("text")),
    _lines_sql(f"(SELECT page_id, {_ENTITIES.format(_TAGLESS.format('html'))} AS t FROM pages)", "page_id", "t"),
)
_BODY = f"regexp_replace({_without('html', 'header', 'footer', 'nav', 'aside', 'script', 'style')}, '(?s)<!--.*?-->', '', 'g')"
_NODES = _SHOWN.format(f"regexp_replace({_BODY}, '<[^>]+>', chr(10), 'g')")
register(
    "i02_page_text",
    lambda s, d: pages(s, d).select("page_id", page_text_udf("html").alias("text")),
    _lines_sql(f"(SELECT page_id, {_NODES} AS t FROM pages)", "page_id", "t"),
)
register(
    "i02_drop_boilerplate",
    lambda s, d: pages(s, d).select("page_id", headings.drop_boilerplate(F.col("html")).alias("html")),
    f"SELECT page_id, {_without('html', 'header', 'footer', 'nav', 'aside', 'script', 'style')} AS html FROM pages",
)


register(
    "i03_clean_markup",
    lambda s, d: pages(s, d).select("page_id", page_markup_udf("html").alias("html")).select("page_id", *markup_content()),
    f"SELECT page_id, {_content_sql('html')} FROM pages",
)
register(
    "i04_headings",
    lambda s, d: headings.page_headings(tagged_pages(s, d)),
    f"""SELECT page_id, level, pos - 1 AS position, trim({_TAGLESS.format('found')}, {_SPACE}) AS text FROM (
 SELECT page_id, 'H' || n AS level, unnest(regexp_extract_all(t, '(?is)<h' || n || '[^>]*>(.*?)</h' || n || '>', 1)) AS found,
  generate_subscripts(regexp_extract_all(t, '(?is)<h' || n || '[^>]*>(.*?)</h' || n || '>', 1), 1) AS pos
 FROM (SELECT page_id, {TAGGED_SQL} AS t FROM pages), (VALUES ('1'), ('2'), ('3')) levels(n))""",
)
register(
    "i04_title",
    lambda s, d: pages(s, d).select("page_id", headings.title_tag(F.col("html")).alias("title")),
    f"SELECT page_id, trim({TITLE_SQL}, {_SPACE}) AS title FROM pages",
)

# ---- links -------------------------------------------------------------------------------

_LINKS_SQL = f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS position, text,
 concat('https://docs.aws.amazon.com', href) AS url, href FROM (
 SELECT page_id, pos, trim({_SHOWN.format(_TAGLESS.format('a'))}, {_SPACE}) AS text, {_SHOWN.format("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')) AS a,
   generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>'), 1) AS pos FROM pages))
 WHERE contains(lower(href), '{LINK_WORD}') OR contains(lower(text), '{LINK_WORD}')"""
register("i05_links", lambda s, d: links.page_links(pages(s, d), LINK_WORD), _LINKS_SQL)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation list of every page taken as its topics box."""
    boxed = F.replace(F.replace("html", F.lit("<nav>"), F.lit('<div class="wide topics">')), F.lit("</nav>"), F.lit("</div>"))
    return links.page_topics(pages(spark, sf_dir).withColumn("html", boxed))


register(
    "i06_topics",
    topics,
    f"""SELECT page_id, pos - 1 AS position, trim({_TAGLESS.format('a')}, {_SPACE}) AS text,
 concat('https://docs.aws.amazon.com', regexp_extract(a, 'href="([^"]*)"', 1)) AS url FROM (
 SELECT page_id, unnest(regexp_extract_all(nav, '<a\\s[^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(nav, '<a\\s[^>]*>.*?</a>'), 1) AS pos
 FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages))""",
)
_VISIBLE = _SHOWN.format(_TAGLESS.format(_without("html", "script", "style")))
_SERVICES_SQL = f"""SELECT page_id, service FROM (SELECT page_id, lower({_VISIBLE}) AS t FROM pages),
 (VALUES {NAMES_SQL}) names(service) WHERE contains(t, lower(service))"""
register("c04_keyword_dictionary", lambda s, d: links.service_mentions(pages(s, d), NAMES), _SERVICES_SQL)
register(
    "i07_service_counts",
    lambda s, d: links.service_mentions(pages(s, d), NAMES).groupBy("service").agg(F.count("*").alias("n")),
    f"SELECT service, count(*) AS n FROM ({_SERVICES_SQL}) GROUP BY 1",
)


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_structures(tagged_pages(spark, sf_dir), LINK_WORD, NAMES)


register(
    "i08_page_structure",
    lambda s, d: structures(s, d).select(
        "page_id",
        "title",
        F.size(F.col("headers")["H1"]).alias("h1"),
        F.size(F.col("headers")["H2"]).alias("h2"),
        "sagemaker_links_count",
        "found_services_count",
    ),
    f"""SELECT p.page_id AS page_id, trim({_SHOWN.format(TITLE_SQL)}, {_SPACE}) AS title, len({H1_SQL}) AS h1, len(regexp_extract_all({TAGGED_SQL}, '(?is)<h2[^>]*>(.*?)</h2>')) AS h2,
 coalesce(l.n, 0) AS sagemaker_links_count, coalesce(s.n, 0) AS found_services_count FROM pages p
 LEFT JOIN (SELECT page_id, count(*) AS n FROM ({_LINKS_SQL}) GROUP BY 1) l ON p.page_id = l.page_id
 LEFT JOIN (SELECT page_id, count(*) AS n FROM ({_SERVICES_SQL}) GROUP BY 1) s ON p.page_id = s.page_id""",
)
register(
    "d16_heading_counts",
    lambda s, d: headings.heading_counts(tagged_pages(s, d)),
    "SELECT page_id, "
    + ", ".join(f"len(regexp_extract_all({TAGGED_SQL}, '(?is)<h{i}[^>]*>(.*?)</h{i}>')) AS h{i}_count" for i in (1, 2, 3))
    + " FROM pages",
)


def structure_files(spark: SparkSession, sf_dir: str) -> str:
    return written_once(
        spark, sf_dir, "structures", lambda p: page_source.write_structures(structures(spark, sf_dir), p)
    )


register(
    "a13_link_urls",
    lambda s, d: page_source.read_link_urls(s, structure_files(s, d)),
    f"SELECT DISTINCT url FROM ({_LINKS_SQL})",
)


def stored_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written records, all fields of each as text, and how often each occurs."""
    records = spark.read.schema(page_source.STRUCTURE_SCHEMA).json(structure_files(spark, sf_dir))
    levels = [F.array_join(F.col("headers")[h], "|").alias(h.lower()) for h in ("H1", "H2", "H3")]
    found = F.array_join(F.transform("sagemaker_links", lambda x: F.concat_ws(">", x["text"], x["url"], x["href"])), "|").alias("links")
    services = F.array_join(F.array_sort("found_services"), "|").alias("services")
    fields = records.select("title", *levels, "sagemaker_links_count", "found_services_count", services, found)
    return fields.groupBy(*fields.columns).agg(F.count("*").alias("n"))


_LEVEL_SQL = f"string_agg({_SHOWN.format('text')}, '|' ORDER BY position) FILTER (level = '{{}}')"
register(
    "a14_structure_files",
    stored_structures,
    f"""SELECT title, h1, h2, h3, sagemaker_links_count, found_services_count, services, links, count(*) AS n FROM (
 SELECT coalesce(nullif(trim({_SHOWN.format(TITLE_SQL)}, {_SPACE}), ''), 'Unknown') AS title, coalesce(h1, '') AS h1, coalesce(h2, '') AS h2, coalesce(h3, '') AS h3,
  coalesce(l.n, 0) AS sagemaker_links_count, coalesce(s.n, 0) AS found_services_count, coalesce(services, '') AS services, coalesce(links, '') AS links FROM pages p
 LEFT JOIN (SELECT page_id, {', '.join(f"{_LEVEL_SQL.format(h)} AS {h.lower()}" for h in ("H1", "H2", "H3"))} FROM ({ORACLES['i04_headings']}) GROUP BY 1) h ON p.page_id = h.page_id
 LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(text || '>' || url || '>' || href, '|' ORDER BY position) AS links FROM ({_LINKS_SQL}) GROUP BY 1) l ON p.page_id = l.page_id
 LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(service, '|' ORDER BY service) AS services FROM ({_SERVICES_SQL}) GROUP BY 1) s ON p.page_id = s.page_id)
 GROUP BY ALL""",
)

# ---- sections and chunks -----------------------------------------------------------------


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).withColumn("source", page_source.page_source(F.col("url")))


_MARKED = _SHOWN.format(
    f"regexp_replace(regexp_replace({_BODY}, '(?i)(<h[1-3])', chr(1) || '\\1', 'g'), '<[^>]+>', chr(10), 'g')"
)
register(
    "i10_sections",
    lambda s, d: chunks.sections(page_rows(s, d)).select("page_id", "section_order", "content"),
    f"""SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS section_order, content FROM (
 SELECT page_id, sec, string_agg(line, chr(10) ORDER BY pos) AS content FROM (
  SELECT page_id, sec, pos, line, row_number() OVER (PARTITION BY page_id, line ORDER BY sec, pos) AS nth FROM (
   SELECT page_id, sec, unnest(generate_series(1, len(lines))) AS pos, trim(unnest(lines), {_SPACE}) AS line FROM (
    SELECT page_id, generate_subscripts(string_split(t, chr(1)), 1) AS sec, string_split(unnest(string_split(t, chr(1))), chr(10)) AS lines
    FROM (SELECT page_id, {_MARKED} AS t FROM pages)))
  WHERE line <> '') WHERE nth = 1 GROUP BY 1, 2)""",
)


def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunks of a text must have, whatever the cuts.

    All lie in the text and fit; together they hold as many characters as the text, blanks apart,
    and at most the overlap for each more; the first begins and the last ends with the text's words.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("whole"))
    rows = chunks.recursive_chunks(documents(spark, sf_dir), "doc_id", "text")
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_order", "content"))).alias("parts"))

    joined = lists.join(docs, "doc_id")
    inside = F.forall("parts", lambda p: F.contains(F.col("whole"), p["content"]))
    fits = F.forall("parts", lambda p: (F.length(p["content"]) <= 1200) & (p["content"] != ""))
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    said = F.aggregate(F.transform("parts", lambda p: F.length(bare(p["content"]))), F.lit(0), lambda a, n: a + n)
    least, most = F.length(bare(F.col("whole"))), F.length(bare(F.col("whole"))) + 120 * F.size("parts")
    first, last = F.element_at("parts", 1)["content"], F.element_at("parts", -1)["content"]
    return joined.select(
        "doc_id", inside.alias("inside"), fits.alias("fits"), said.between(least, most).alias("covers"),
        F.regexp_extract(first, r"^\S+", 0).alias("begins"), F.regexp_extract(last, r"\S+$", 0).alias("ends"),
    )


_BARE = "trim(text, chr(32) || chr(9) || chr(10) || chr(13))"
register(
    "i11_recursive_chunks",
    chunk_cover,
    f"""SELECT doc_id, true AS inside, true AS fits, true AS covers, regexp_extract({_BARE}, '^\\S+') AS begins,
 regexp_extract({_BARE}, '\\S+$') AS ends FROM documents WHERE {_BARE} <> ''""",
)


def recursive_chunks_sql(rows: str, size: int = 1200, overlap: int = 120) -> str:
    """(key, chunk_order, content) of (key, content) rows, in relational steps.

    A separator after the other, texts of ``size`` or more are cut into pieces; neighbouring short ones
    are a run. A run's chunks are found from running lengths: a chunk ends before the piece that would
    make it too long, and the next begins with the first piece from which what is left of the overlap,
    and that piece with it, fits.
    """
    separators = ("chr(10) || chr(10)", "chr(10)", "' '")
    steps = [f"r AS ({rows})", "l0 AS (SELECT key, CAST([] AS BIGINT[]) AS path, content AS t FROM r WHERE content <> '')"]
    for k, s in enumerate(separators, 1):
        cut = f"string_split(t, {s})"
        pieces = f"list_transform({cut}, lambda x, i: CASE WHEN i = 1 THEN x ELSE {s} || x END)"
        steps += [
            f"p{k} AS (SELECT key, path AS above, list_append(path, i) AS path, t FROM (SELECT key, path, unnest({pieces}) AS t, "
            f"generate_subscripts({cut}, 1) AS i FROM l{k - 1} WHERE contains(t, {s})) WHERE t <> '')",
            f"f{k} AS (SELECT key, list_append(above, -1) || [sum(CASE WHEN length(t) >= {size} THEN 1 ELSE 0 END) OVER "
            f"(PARTITION BY key, above ORDER BY path)] AS run, path, t FROM p{k})",
            f"l{k} AS (SELECT key, path, t FROM l{k - 1} WHERE NOT contains(t, {s}) UNION ALL SELECT key, path, t FROM p{k} WHERE length(t) >= {size})",
        ]
    letters = "SELECT key, list_append(path, -1) AS run, list_append(path, i) AS path, substr(t, i, 1) AS t FROM (SELECT key, path, t, unnest(range(1, length(t) + 1)) AS i FROM l3)"
    short = " UNION ALL ".join(f"SELECT key, run, path, t FROM f{k} WHERE length(t) < {size}" for k in (1, 2, 3))
    return f"""WITH RECURSIVE {', '.join(steps)}, g AS (SELECT key, run, min(path) AS place, list(t ORDER BY path) AS ts FROM ({short} UNION ALL {letters}) GROUP BY key, run),
 h AS (SELECT key, place, ts, list_transform(range(0, len(ts) + 1), lambda i: CAST(coalesce(list_sum(list_transform(ts[:i], lambda x: length(x))), 0) AS BIGINT)) AS c FROM g),
 c AS (SELECT key, place, ts, c, 0 AS a, len(list_filter(c, lambda x: x <= {size})) - 1 AS b FROM h
  UNION ALL SELECT key, place, ts, c, n AS a, len(list_filter(c, lambda x: x <= c[n + 1] + {size})) - 1 AS b FROM (
   SELECT key, place, ts, c, len(list_filter(c, lambda x: x < greatest(c[b + 1] - {overlap}, c[b + 2] - {size}))) AS n FROM c WHERE b < len(ts)))
 SELECT key, row_number() OVER (PARTITION BY key ORDER BY place, a, b) - 1 AS chunk_order, content FROM (
  SELECT key, place, a, b, trim(array_to_string(ts[a + 1:b], ''), {_SPACE}) AS content FROM c) WHERE content <> ''"""


register(
    "i11_recursive_chunk_rows",
    lambda s, d: chunks.recursive_chunks(documents(s, d), "doc_id", "text"),
    "SELECT key AS doc_id, chunk_order, content FROM ("
    + recursive_chunks_sql("SELECT doc_id AS key, text AS content FROM documents WHERE text IS NOT NULL")
    + ")",
)
_WINDOWS_SQL = f"""SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_order, content FROM (
 SELECT doc_id, source, pos, trim(substr(text, cast(1 + pos * 1080 AS bigint), 1200), {_SPACE}) AS content FROM (
  SELECT doc_id, source, text, unnest(range(greatest(1, cast(ceil((length(text) - 120) / 1080.0) AS bigint)))) AS pos FROM documents))
 WHERE content <> ''"""
register(
    "i12_window_chunks",
    lambda s, d: chunks.window_chunks(documents(s, d), "doc_id", "text"),
    f"SELECT doc_id, chunk_order, content FROM ({_WINDOWS_SQL})",
)
register(
    "h07_chunk_ids",
    lambda s, d: chunks.window_chunks(documents(s, d), "doc_id", "text").select(
        chunks.chunk_id(F.col("doc_id").cast("string"), F.lit(4), F.col("chunk_order")).alias("id")
    ),
    f"SELECT format('{{}}#s04#{{:04d}}', doc_id, chunk_order) AS id FROM ({_WINDOWS_SQL})",
)


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_index.page_chunks(pages(spark, sf_dir), VERSION)


register(
    "i13_chunk_metadata",
    lambda s, d: index_chunks(s, d)
    .select("page_id", "title", "section", "url", "version_date", "doc_type", F.substring_index("id", "#", 1).alias("stem"))
    .distinct(),
    f"""SELECT page_id, coalesce(nullif(trim({_TAGLESS.format(f'{H1_SQL}[1]')}, {_SPACE}), ''), {TITLE_SQL}) AS title, 'General' AS section, url,
 '{VERSION}' AS version_date, 'developer-guide' AS doc_type, {STEM_SQL} AS stem FROM pages""",
)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def word_vector(texts: pd.Series) -> pd.Series:
    """A stand-in for an outside embedder: counts of hashed words, scaled to length 1."""

    def embed(text: str) -> np.ndarray:
        places = [zlib.crc32(w.encode()) % 64 for w in text.split()]
        counts = np.bincount(places, minlength=64).astype(np.float32)
        return counts / max(1.0, float(np.linalg.norm(counts)))

    return texts.map(embed)


def index_store(spark: SparkSession, sf_dir: str) -> str:
    """The chunk store after two runs over the same pages."""

    def write(path: str) -> None:
        for _ in range(2):
            chunk_index.add_pages(spark, pages(spark, sf_dir), path, VERSION, word_vector)

    return written_once(spark, sf_dir, "chunk-store", write)


register("i14_chunk_index", lambda s, d: chunk_index.read_store(s, index_store(s, d)))
_PAGE_CHUNKS_SQL = recursive_chunks_sql(f"SELECT struct_pack(page_id, section_order) AS key, content FROM ({ORACLES['i10_sections']})")
_CHUNK_ROWS_SQL = f"SELECT key.page_id AS page_id, key.section_order AS section_order, chunk_order, content FROM ({_PAGE_CHUNKS_SQL})"
register(
    "i14_chunk_ids",
    lambda s, d: chunk_index.read_store(s, index_store(s, d)).select("id", "url", "text_hash"),
    f"""SELECT format('{{}}#s{{:02d}}#{{:04d}}', {STEM_SQL}, section_order, chunk_order) AS id, url, md5(content) AS text_hash
 FROM ({_CHUNK_ROWS_SQL}) JOIN pages USING (page_id)
 QUALIFY row_number() OVER (PARTITION BY md5(content) ORDER BY {STEM_SQL}, url, section_order, chunk_order) = 1""",
)


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the store holds each chunk of the pages, after two runs over the same pages."""
    wanted = index_chunks(spark, sf_dir).select(F.md5("content").alias("text_hash")).distinct()
    stored = chunk_index.read_store(spark, index_store(spark, sf_dir))
    right = (F.col("text_hash") == F.md5("content")) & (F.size("embedding") == 64)
    kept = stored.where(right).groupBy("text_hash").agg(F.count("*").alias("n"))
    return wanted.join(kept, "text_hash", "left").select("text_hash", F.coalesce("n", F.lit(0)).alias("n"))


register(
    "a15_store_append",
    stored_chunks,
    f"SELECT DISTINCT md5(content) AS text_hash, 1 AS n FROM ({_CHUNK_ROWS_SQL})",
)


def found_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to chunks to a stored search: every chunk is asked for.

    Each question has eight contexts with ranks of their own, all different texts, and the best
    of them is as near as the chunk itself.
    """
    stored = chunk_index.read_store(spark, index_store(spark, sf_dir))
    asked = stored.select(F.col("text_hash").alias("query_id"), "embedding")
    rows = search.search_store(stored, asked, 20, 8, 0.0)
    return rows.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_list("rank")).cast("array<string>"), ",").alias("ranks"),
        F.countDistinct(F.md5("text")).alias("texts"),
        F.round(F.max("score"), 5).alias("best"),
    )


register(
    "j06_store_search",
    found_in_store,
    f"""SELECT query_id, array_to_string(range(1, 1 + least(8, n)), ',') AS ranks, least(8, n) AS texts, 1.0 AS best
 FROM (SELECT *, count(*) OVER () AS n FROM (SELECT DISTINCT md5(content) AS query_id FROM ({_CHUNK_ROWS_SQL})))""",
)
register(
    "a16_chunk_manifest",
    lambda s, d: chunks.chunk_manifest(
        chunks.window_chunks(documents(s, d), "doc_id", "text").join(documents(s, d).select("doc_id", "source"), "doc_id"),
        VERSION,
    ),
    f"""SELECT 'developer-guide' AS doc_type, '{VERSION}' AS version_date, count(DISTINCT source) AS num_docs, count(*) AS num_chunks
 FROM ({_WINDOWS_SQL})""",
)


def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored manifest rows of both runs, with the pages' chunks counted again."""
    path = index_store(spark, sf_dir)
    chunk_count = index_chunks(spark, sf_dir).agg(F.count("*").alias("counted"))
    rows = chunk_index.read_manifest(spark, path).join(F.broadcast(chunk_count), F.col("num_chunks") == F.col("counted"))
    return rows.select("doc_type", "version_date", "num_docs", (F.col("index_dir") == path).alias("names_store"))


register(
    "a16_page_manifest",
    page_manifest,
    f"""SELECT 'developer-guide' AS doc_type, '{VERSION}' AS version_date, count(DISTINCT concat({STEM_SQL}, '.html')) AS num_docs,
 true AS names_store FROM pages, (VALUES (1), (2)) runs(run) GROUP BY run""",
)

# ---- copies ------------------------------------------------------------------------------

register(
    "g02_prefix_dedup",
    lambda s, d: dedup.dedup_by_prefix(documents(s, d), "text", ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5")),
    f"""SELECT doc_id, md5(text) AS text_md5 FROM documents
 QUALIFY row_number() OVER (PARTITION BY trim(left(text, 100), {_SPACE}) ORDER BY doc_id) = 1""",
)
register(
    "g03_line_dedup",
    lambda s, d: documents(s, d).select("doc_id", distinct_lines(F.col("text")).alias("text")).where("text <> ''"),
    _lines_sql("documents", "doc_id", "text"),
)
register(
    "g04_hash_dedup",
    lambda s, d: dedup.dedup_by_hash(dedup.with_text_hash(documents(s, d), "text"), ["doc_id"]).select(
        "doc_id", "text_hash", "source"
    ),
    "SELECT doc_id, md5(text) AS text_hash, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
)


def unknown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch is all documents, the store holds the texts of the labelled ones."""
    hashed = dedup.with_text_hash(documents(spark, sf_dir), "text")
    store = hashed.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return dedup.drop_known(dedup.dedup_by_hash(hashed, ["doc_id"]), store).select("doc_id", "text_hash")


register(
    "c03_known_hash_anti_join",
    unknown_documents,
    """SELECT doc_id, md5(text) AS text_hash FROM documents
 WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
 QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""",
)
def nfkc_sql(rows: str) -> str:
    """(key, t) of (key, t) rows with compatibility forms replaced, letter by letter, and then composed.

    The table of forms comes from the Unicode data that Python has: letters whose compatibility form
    is not their composed form.
    """
    letters = (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    forms = ((c, unicodedata.normalize("NFKC", c)) for c in letters)
    plain = [(ord(c), f.replace("'", "''")) for c, f in forms if f != unicodedata.normalize("NFC", c)]
    table = ", ".join(f"({i}, '{f}')" for i, f in plain)
    return f"""WITH forms(i, form) AS (VALUES {table}), r AS ({rows}),
 letters AS (SELECT key, unnest(regexp_extract_all(t, '(?s).')) AS c, generate_subscripts(regexp_extract_all(t, '(?s).'), 1) AS n FROM r),
 folded AS (SELECT key, nfc_normalize(string_agg(coalesce(form, c), '' ORDER BY n)) AS t FROM letters LEFT JOIN forms ON i = ord(c) GROUP BY key)
 SELECT r.key, CASE WHEN r.t = '' THEN '' ELSE folded.t END AS t FROM r LEFT JOIN folded USING (key)"""


_FORMS = r"\u00b2 \uff21\uff42 \ufb01 e\u0301 \u1e9b\u0323 \u3392 \u2460 \uff07 \u212b \u0344 ".encode().decode("unicode_escape")
register(
    "h04_nfkc",
    lambda s, d: documents(s, d).select("doc_id", F.md5(nfkc_udf(F.concat(F.lit(_FORMS), F.col("text")))).alias("text_md5")),
    "SELECT key AS doc_id, md5(t) AS text_md5 FROM ("
    + nfkc_sql(f"SELECT doc_id AS key, '{_FORMS}' || text AS t FROM documents")
    + ")",
)
register(
    "h05_entity_decode",
    lambda s, d: pages(s, d).select("page_id", decode_entities(F.col("html")).alias("html")),
    f"SELECT page_id, {_ENTITIES.format('html')} AS html FROM pages",
)
register(
    "h06_title_case",
    lambda s, d: table(s, d, "part").select("p_partkey", title_case(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title")),
    "SELECT p_partkey, array_to_string([concat(upper(left(w, 1)), lower(substr(w, 2))) for w in string_split(p_name, ' ')], ' ') AS title FROM part",
)
register(
    "h13_json_metadata",
    lambda s, d: chunks.flat_metadata(
        table(s, d, "conversations").select(
            F.col("conv_id"),
            F.struct("turn", "role").alias("head"),
            F.when(F.col("turn") > 0, F.col("role")).alias("maybe"),
            F.create_map(F.lit("who"), F.col("role")).alias("pairs"),
            F.array("turn", "conv_id").alias("numbers"),
        )
    ),
    "SELECT conv_id, concat('{\"who\":\"', role, '\"}') AS pairs, concat('[', turn, ',', conv_id, ']') AS numbers, concat('{\"turn\":', turn, ',\"role\":\"', role, '\"}') AS head, CASE WHEN turn > 0 THEN role ELSE '' END AS maybe FROM conversations",
)
register(
    "h10_megabytes",
    lambda s, d: documents(s, d).groupBy("lang").agg(megabytes(F.sum("n_chars")).alias("size_mb")),
    "SELECT lang, round(sum(n_chars) / 1048576.0, 2) AS size_mb FROM documents GROUP BY 1",
)

# Targets of every form, made from the page's own address.
_PATH_ONLY = "regexp_replace(url, '^[a-z]+://[^/]+', '')"
_HREFS = {
    "full": "url",
    "rooted": _PATH_ONLY,
    "relative": f"substr({_PATH_ONLY}, 2)",
    "above": f"'..' || {_PATH_ONLY}",
    "around": f"'./a/..' || {_PATH_ONLY}",
    "fragment": "'#' || cast(page_id AS {string})",
}


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = [f"'{form}', {e.format(string='string')}" for form, e in _HREFS.items()]
    rows = pages(spark, sf_dir).selectExpr("page_id", f"stack({len(hrefs)}, {', '.join(hrefs)}) AS (form, href)")
    return rows.select("page_id", "form", links.absolute_url(F.col("href")).alias("url"))


register(
    "h12_absolute_url",
    resolved,
    f"""SELECT page_id, form, url FROM (
 SELECT page_id, unnest(['full', 'rooted', 'relative', 'above', 'around', 'fragment']) AS form,
  unnest([url, 'https://docs.aws.amazon.com' || p, 'https://docs.aws.amazon.com/sagemaker/latest/dg' || p,
   'https://docs.aws.amazon.com/sagemaker/latest' || p, 'https://docs.aws.amazon.com/sagemaker/latest/dg' || p,
   'https://docs.aws.amazon.com/sagemaker/latest/dg/#' || page_id]) AS url
 FROM (SELECT page_id, url, {_PATH_ONLY} AS p FROM pages))""",
)
