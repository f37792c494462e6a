"""The registered queries: a Spark callable each, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Columns that are 32-bit integers in Spark, while DuckDB counts in 64 bits.
INTS = {
    "a09_schema_catalog": ["ordinal"],
    "a11_month_info": ["file_count"],
    "a14_structure_files": ["sagemaker_links_count"],
    "a17_contract_summary": ["account_count"],
    "c05_neighbour_join": ["rank"],
    "d16_heading_counts": ["h1_count"],
    "f03_top_k_then_top_n": ["rank"],
    "g02_context_prefix_dedup": ["rank"],
    "i04_headings": ["position"],
    "i05_links": ["position"],
    "i06_topics": ["position"],
    "i08_page_structure": ["h1", "sagemaker_links_count", "found_services_count"],
    "i10_sections": ["section_order"],
    "i12_window_chunks": ["chunk_order"],
    "j02_top_k": ["rank"],
    "j04_mean_gate": ["rank"],
    "j05_context_rows": ["rank"],
    "j06_search": ["rank"],
    "j09_score_report": ["rank"],
}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is None:
        return
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in INTS.get(name, []))
    ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


_WRITTEN: dict[tuple, str] = {}


def written_once(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """The path of a table that several queries read back, written once per application."""
    from costdocs.sources.scratch import scratch_path

    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _WRITTEN:
        path = scratch_path(spark, label)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]
