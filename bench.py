"""Headline builds and queries, timed: one JSON line on stdout.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Builds (chunks, vectors, words, BM25 index) are timed on their own, from
the tables they start from to a no-op sink. Every query runs once to warm up and is then timed once; the searches read the stored chunks, vectors and
index, whose builds are listed beside them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docspark.operators import bm25, chunking, dense, matching  # noqa: E402
from docspark.plans import catalog, derived  # noqa: E402
from docspark.session import ship_package  # noqa: E402

HEADLINE = (
    "chunk_document", "embed_chunks", "bm25_search", "vector_topk", "hybrid_search", "smart_search", "sync_classify",
    "sync_apply", "page_coverage", "history_window", "usage_kpis", "verdict_distribution", "channel_breaker",
)
BUILDS = {
    "build_chunks": lambda spark, sf: chunking.chunk_documents(derived.corpus(spark, sf)),
    "build_vectors": lambda spark, sf: dense.embed_chunks(derived.spread(derived.chunks(spark, sf))),
    "build_words": lambda spark, sf: matching.word_index(derived.spread(derived.chunks(spark, sf))),
    "build_vocabulary": lambda spark, sf: matching.vocabulary(derived.words(spark, sf)),
    "build_bm25_index": lambda spark, sf: bm25.chunk_terms(derived.spread(derived.chunks(spark, sf))),
    "build_bm25_terms": lambda spark, sf: bm25.term_stats(derived.bm25_index(spark, sf)),
}


def run(spark: SparkSession, name: str, sf: str) -> float:
    start = time.time()
    (BUILDS.get(name) or catalog.QUERIES[name])(spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or (*BUILDS, *HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("docspark-bench").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    times, first = {}, {}
    for name in names:
        first[name] = round(run(spark, name, sf), 3)
        times[name] = round(run(spark, name, sf), 3)
        print(name, first[name], times[name], file=sys.stderr, flush=True)
    asked = derived.table(spark, sf, "benchmark").count()
    per_question = {n: round(times[n] / asked * 1000, 2) for n in ("bm25_search", "vector_topk", "hybrid_search", "smart_search") if n in times}
    print(json.dumps({
        "metric": "total_time_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first_run": first,
        "ms_per_question": per_question, "questions": asked, "cpus": cpus, "sf": Path(sf).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
