"""Evidence refresh over many runs at once: scope, answers, canonical pages, telemetry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from citegrain.operators import citations as C
from citegrain.operators import crawl, hygiene as H, mapping, merging
from citegrain.operators.ordinals import first_or_all
from citegrain.operators.portfolio import normalise_queries
from citegrain.session import checkpointed


@dataclass(frozen=True)
class RefreshOptions:
    """Limits and switches of a refresh; without a limit all queries and all mapped URLs of a run are kept.

    ``pages_per_query`` is the k of the mapping, whose purpose is the best k pages of each query.
    """

    query_limit: int | None = None
    pages_per_query: int = 3
    max_owned_urls: int | None = None
    crawl_owned: bool = True
    collect_answers: bool = False


def scope(queries: DataFrame, urls: DataFrame, options: RefreshOptions = RefreshOptions()) -> dict[str, DataFrame]:
    """Portfolio queries and site URLs → queries, mappings, selected pages, placeholders.

    ``queries``: run_id, pos, query_id, query, topic, recommended_page_type; ``urls``: run_id, pos, url.
    """
    # the mapping reads the queries many times; it is the costly part and feeds four outputs
    capped = checkpointed(first_or_all(normalise_queries(queries), "run_id", ["pos"], options.query_limit, rank="query_rank"))
    mappings = checkpointed(mapping.map_queries(capped, urls, options.pages_per_query))
    selected = mapping.selected_urls(mappings, options.max_owned_urls)
    status = "pending" if options.crawl_owned else "not_requested"
    about = "awaiting crawl." if options.crawl_owned else "mapped from sitemap; crawl disabled for this refresh."
    pages = (
        selected.join(mapping.mapping_rollup(mappings, capped), ["run_id", "url"], "left")
        .select(
            "run_id", F.col("rank").alias("pos"), "url", F.col("url").alias("final_url"), "rank",
            F.coalesce("mapping_quality", F.lit("fallback_candidate")).alias("mapping_quality"),
            F.coalesce("mapping_score", F.lit(0)).alias("mapping_score"), "brand_topic_category",
            F.coalesce("related_queries_seed", F.array().cast("array<string>")).alias("related_queries_seed"),
            F.coalesce("query_count", F.lit(0)).alias("query_count"),
            F.lit(status).alias("crawl_status"), F.lit(status).alias("extraction_status"),
            F.lit(False).alias("geo_analysis_ready"), F.lit("metadata_only_until_crawled").alias("content_score_policy"),
            F.lit(f"Owned URL candidate {about}").alias("description"),
        )
    )
    placeholder = "SerpAPI collection pending." if options.collect_answers else "SerpAPI collection was not run for this refresh."
    answers = capped.select(
        "run_id", "pos", "query_id", "query", F.col("topic").alias("brand_topic_category"),
        F.array().cast(f"array<{C.RAW_REFERENCE}>").alias("references"), F.lit(placeholder).alias("answer_summary"),
        F.lit(None).cast("string").alias("status"),
    )
    visibility = capped.select(
        "run_id", "pos", "query_id", "query", F.col("topic").alias("brand_topic_category"),
        F.lit("pending_collection" if options.collect_answers else "not_collected").alias("visibility_status"),
    )
    counts = (
        capped.groupBy("run_id").agg(F.count("*").alias("queries"))
        .join(selected.groupBy("run_id").agg(F.count("*").alias("owned_pages")), "run_id", "full_outer")
        .join(mappings.groupBy("run_id").agg(F.count("*").alias("mappings")), "run_id", "full_outer")
        .join(urls.groupBy("run_id").agg(F.count("*").alias("sitemap_urls")), "run_id", "full_outer")
        .na.fill(0)
    )
    return {
        "queries": capped, "mappings": mappings, "owned_pages": pages, "answers": answers,
        "visibility": visibility, "counts": counts,
    }


def prefer_collected(placeholders: DataFrame, collected: DataFrame) -> DataFrame:
    """Collected answers over placeholders, per run and query."""
    both = collected.withColumn("_layer", F.lit(0)).unionByName(
        placeholders.withColumn("_layer", F.lit(1)), allowMissingColumns=True
    )
    return merging.keep_richer(both, ["run_id", "query_id"], F.col("_layer"), "pos").drop("_layer")


HINTS = ("title", "source_name", "source_type", "snippet", "citation_position")


def canonicalise(owned: DataFrame, external: DataFrame, answers: DataFrame, queries: DataFrame) -> dict[str, DataFrame]:
    """Crawl and citation evidence of many runs in canonical form, with telemetry.

    ``owned``/``external``: page rows with run_id, pos, url; ``answers``: run_id, pos, query_id,
    query, references; ``queries``: the visibility scope. All citations of an answer
    feed the hints, the per-query figures, the source table and the citation total.
    """
    clean_answers = C.normalise_answers(answers)
    cites = C.explode_citations(clean_answers)
    owned_pages = crawl.enrich_pages(owned)
    hinted = merging.fill_from_hints(
        external, cites.withColumn("ord", F.struct("query_id", "pos")), HINTS
    )
    external_pages = crawl.enrich_pages(hinted, external=True, hint_prefix="hint_").drop(*[f"hint_{h}" for h in HINTS])
    attributes = ("title", "source_domain", "source_name", "snippet", "source_type", "rank")
    source_rows = C.sources(cites, ("run_id",), ("query_id", "pos"), attributes)
    known = [c for c in ("crawl_status", "word_count", "geo_analysis_ready") if c in external_pages.columns]
    crawled_sources = source_rows.join(
        merging.first_wins(external_pages.select("run_id", "url", "pos", *known), ["run_id", "url"], "pos").drop("pos"),
        ["run_id", "url"], "left",
    )
    both = owned_pages.select("run_id", "crawl_status", "word_count", "geo_analysis_ready", F.lit("owned").alias("kind")).unionByName(
        external_pages.select("run_id", "crawl_status", "word_count", "geo_analysis_ready", F.lit("external").alias("kind"))
    )
    return {
        "owned_pages": owned_pages,
        "external_pages": external_pages,
        "answers": clean_answers,
        "citations": cites,
        "sources": crawled_sources,
        "source_queries": C.source_queries(cites),
        "source_type_counts": C.source_type_counts(source_rows, "run_id"),
        "visibility": C.visibility(queries.drop("visibility_status"), cites),
        "telemetry": crawl.run_telemetry(both, clean_answers.select("run_id", F.col("citation_count"))),
    }


def site_hygiene(owned_pages: DataFrame, files: DataFrame) -> DataFrame:
    """Hygiene per run from owned pages and fetched-file statuses.

    ``files``: run_id, robots_status, robots_attempts, llms_status, llms_attempts and any further columns, which
    stay. Runs without owned pages have a row of zeros.
    """
    coverage = H.coverage_with_files(owned_pages, files)
    return H.hygiene(
        coverage.withColumnsRenamed({"robots_status": "_robots", "llms_status": "_llms"}),
        H.file_status("_robots", F.col("robots_attempts")), H.file_status("_llms", F.col("llms_attempts")),
    ).drop("_robots", "_llms", "robots_attempts", "llms_attempts")
