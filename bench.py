"""Times the headline queries, the better of two runs each, and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. The line items are made
from the star schema and written once; operators on them are timed over that table, without the
join and without the repartition of small inputs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from costdocs.checks import QUERIES, fixtures, text  # noqa: E402
from costdocs.checks.cost import GUARDED_SQL  # noqa: E402
from costdocs.operators import classify, rollups, search  # noqa: E402
from costdocs.operators.flags import fact  # noqa: E402
from costdocs.operators.guard import run_guarded  # noqa: E402
from costdocs.plans import chunk_index, mart, scenarios  # noqa: E402
from costdocs.session import local_session  # noqa: E402
from costdocs.sources import cost as cost_source  # noqa: E402
from costdocs.sources.scratch import remove, scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Queries over pages, documents, vectors, logs: timed as they are registered.
AS_REGISTERED = [
    "k02_keyword_intent",
    "k06_extract_sql",
    "i01_plain_text",
    "i02_page_text",
    "i05_links",
    "i08_page_structure",
    "i10_sections",
    "i11_recursive_chunk_rows",
    "i12_window_chunks",
    "i13_chunk_metadata",
    "g02_prefix_dedup",
    "g04_hash_dedup",
    "c03_known_hash_anti_join",
    "j02_top_k",
    "c05_neighbour_join",
    "j05_context_rows",
    "j07_context_text",
]


def over_line_items(spark, path: str) -> dict:
    """Operators on the stored line items."""
    items = lambda: cost_source.extract(spark.read.parquet(path))
    facts = lambda: fact(items())

    def mapped():
        answer = F.coalesce(F.substring("lineitem_usagetype", 4, 4), F.lit("none"))
        return classify.apply_mapping(items(), classify.distinct_keys(items()).withColumn("category", answer))

    timed = {
        "b01_projection": lambda: spark.read.parquet(path).select(*cost_source.CUR_COLUMNS),
        "b21_rule_category": lambda: classify.categorise(items()).groupBy("rule_category").count(),
        "c02_category_write_back": lambda: mapped().groupBy("llm_category").count(),
        "d13_mart_fact": facts,
        "d13_mart_single_pass": lambda: rollups.summarise_all(facts()),
        "l03_guarded_select": lambda: run_guarded(spark, GUARDED_SQL, mart.build(items())),
        "o05_idle_endpoints": lambda: scenarios.idle_endpoints(facts(), max_hours=2000.0),
        "o06_tag_missing_rate": lambda: scenarios.tag_missing_rate(facts(), cost_source.TAG_COLUMNS),
        "o07_spike_causes": lambda: scenarios.spike_causes(facts()),
        "o08_service_costs": lambda: scenarios.service_costs(facts()),
    }
    for i, name in enumerate(rollups.ROLLUP, 1):
        timed[f"d{i:02d}_{name}"] = lambda name=name: rollups.summarise(facts(), name)
    return timed


def whole_jobs(spark, path: str) -> dict:
    """What writes: each run has a folder of its own, removed afterwards."""

    def written(label: str, job) -> None:
        target = scratch_path(spark, f"bench-{label}")
        try:
            job(target)
        finally:
            remove(spark, target)

    items = lambda: cost_source.extract(spark.read.parquet(path))
    pages = lambda: spark.read.parquet(f"{SF_DIR}/pages.parquet")
    store = text.index_store(spark, SF_DIR)

    def stored_search() -> None:
        chunks = chunk_index.read_store(spark, store)
        asked = chunks.where(F.crc32("text_hash") % 10 == 0).select(F.col("text_hash").alias("query_id"), "embedding")
        search.search_store(chunks, asked, threshold=0.0).write.format("noop").mode("overwrite").save()

    return {
        "write_mart": lambda: written("mart", lambda p: mart.write_mart(spark, items(), p)),
        "add_pages": lambda: written("chunks", lambda p: chunk_index.add_pages(spark, pages(), p, text.VERSION, text.word_vector)),
        "search_store": stored_search,
    }


def seconds(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def read_through(make) -> float:
    return seconds(lambda: make().write.format("noop").mode("overwrite").save())


def main() -> None:
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    path = scratch_path(spark, "bench-line-items")
    fixtures.cost_table(spark, SF_DIR).write.parquet(path)
    makers = {**over_line_items(spark, path), **{n: (lambda n=n: QUERIES[n](spark, SF_DIR)) for n in AS_REGISTERED}}
    for name in ("d01_agg_endpoint_hours", "i02_page_text", "j02_top_k"):
        read_through(makers[name])  # start the JVM's compiler and the Python workers
    times = {name: round(min(read_through(make) for _ in range(2)), 3) for name, make in makers.items()}
    times |= {name: round(min(seconds(job) for _ in range(2)), 3) for name, job in whole_jobs(spark, path).items()}
    remove(spark, path)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
