"""From pages to a stored table of embedded chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costdocs.operators.chunks import attach_metadata, chunk, chunk_manifest, flat_metadata, sections
from costdocs.operators.dedup import dedup_by_hash, dedup_unknown, with_text_hash
from costdocs.plans import chunk_store
from costdocs.sources.pages import page_source
from costdocs.sources.scratch import scratch_table

ORDER = ["source", "url", "section_order", "chunk_order"]
MANIFEST_TYPE = "doc_type string, version_date string, num_docs long, num_chunks long, index_dir string"


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}-manifest"


def page_chunks(
    pages: DataFrame,
    version_date: str,
    doc_type: str = "developer-guide",
    size: int = 1200,
    overlap: int = 120,
    limit: int | None = None,
) -> DataFrame:
    """Chunks with metadata of all pages, copies included.

    Sections are cut from the raw page: boilerplate goes in the same walk, so the cleaned
    markup need not be written out in between.
    """
    df = pages.limit(limit) if limit else pages
    documents = df.select("page_id", "url", page_source(F.col("url")).alias("source"), "html")
    return attach_metadata(chunk(sections(documents), size, overlap), version_date, doc_type)


def new_chunks(chunks: DataFrame, near: Callable[[DataFrame], DataFrame | None] = lambda _: None) -> DataFrame:
    """Chunks whose text is neither in the store nor earlier in the batch, flattened for storage.

    Only md5 and order decide; copies are merged inside the map tasks before any shuffle. ``near`` gives
    the stored rows that hashed rows may be equal to. Hashes alone are compared with the store; those that
    it has take part in the merging, so that the texts are moved once for both.
    """
    flat = flat_metadata(with_text_hash(chunks))
    store = near(flat)
    return dedup_by_hash(flat, ORDER) if store is None else dedup_unknown(flat, store, ORDER)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """All stored chunks; None without a store."""
    return chunk_store.read(spark, path)


def add_pages(
    spark: SparkSession,
    pages: DataFrame,
    path: str,
    version_date: str,
    embed: Callable[[Column], Column] | None = None,
    vectors: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Append the new chunks of the pages to the store and return the manifest row.

    Embeddings come from a column function, or from a table (``text_hash``, ``embedding``); a
    chunk without a vector there is not stored and comes up again next time. The chunks are
    written to the shared folder once and read for both the manifest, which counts copies too,
    and the store. Copies and known chunks are left out before ``embed`` runs, as that is the
    costly step. A repeated run adds nothing twice, and of a run that fails nothing is seen
    (:mod:`costdocs.plans.chunk_store`). The manifest row is also appended to the JSON
    table beside the store (:func:`manifest_path`).
    """
    if (embed is None) == (vectors is None):
        raise ValueError("give either embed or vectors")
    with scratch_table(spark, "chunks") as staged:
        page_chunks(pages, version_date, **options).write.parquet(staged)
        chunks = spark.read.parquet(staged)

        def embedded(near: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
            fresh = new_chunks(chunks, near)
            if embed is not None:
                return fresh.withColumn("embedding", embed(F.col("content")))
            return fresh.join(vectors.select("text_hash", "embedding"), "text_hash").select(*fresh.columns, "embedding")

        chunk_store.append(spark, path, embedded)
        row = chunk_manifest(chunks, version_date, options.get("doc_type", "developer-guide")).first()
    record = spark.createDataFrame([(*row, path)], MANIFEST_TYPE)
    record.coalesce(1).write.mode("append").json(manifest_path(path))
    return record


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per run: type, version, documents, chunks and the store's folder."""
    return spark.read.schema(MANIFEST_TYPE).json(manifest_path(path))
