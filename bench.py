"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import catalogue
from citegrain.session import local_session

# Queries that stand for the work of the library: HTML job, text features, scores, hygiene,
# mapping, citation statistics, merging, registry, status and JSON.
HEADLINE = (
    "hygiene_readiness_by_host", "html_links", "link_host_counts", "full_page_markdown", "doc_word_counts", "line_dedupe",
    "markdown_metrics", "clean_markdown", "keyword_tokens", "token_frequency", "readiness_score", "text_feature_scores", "geo_signals",
    "page_enrichment", "run_telemetry", "query_page_mapping", "mapping_rollup", "citation_sources", "citation_per_query", "top_citations",
    "citation_dedupe", "merge_pages", "inventory_union", "latest_run", "completeness", "portfolio_validation", "status_fold", "active_runs",
    "status_episodes", "json_urls", "sitemap_read", "report_readiness", "refresh_scope", "page_manifest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), shuffle_partitions=8, memory=os.environ.get("BENCH_MEMORY", "12g"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # start the executor and the Python workers before the clock
    spark.range(1000).repartition(8).mapInArrow(lambda batches: batches, "id long").selectExpr("sum(id)").collect()
    # and let the JVM compile on a query that reads HTML and text
    catalogue.QUERIES["hygiene_readiness_by_host"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
