"""Run registry: manifests, latest pointers, history, retention, brand configurations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import text_or_empty
from citegrain.operators.frames import ensure_columns, first_n

# Status words.
SUCCESS_STATES = ("success", "successful", "completed", "succeeded", "ready")
IN_PROGRESS_STATES = ("queued", "accepted", "pending", "running", "in_progress", "processing")
FAILED_STATES = ("failed", "error", "cancelled", "canceled")
REPORT_READY_STAGES = ("report_bundle_ready",)
REQUIRED_ARTIFACTS = (
    "audit_context", "evidence_scope", "google_ai_mode_compact", "owned_pages_full",
    "external_pages_full", "visibility_matrix", "source_classification",
)
BASELINE_ARTIFACTS = (
    "audit_context", "evidence_scope", "google_ai_mode_compact", "visibility_matrix", "source_classification",
)
REPORT_LISTS = (
    "query_workbench", "queries", "owned_url_readiness", "owned_pages", "cms_recommendations",
    "page_level_cms_recommendations", "action_checklist", "source_landscape_sources",
    "source_landscape_citation_domains", "visibility_queries", "visibility_rows", "preview_tiles", "tiles",
)

_MANIFEST = {
    "run_id": "string", "brand": "string", "market": "string", "domain": "string", "stage": "string",
    "status": "string", "dashboard_ready": "boolean", "created_at_epoch": "bigint",
    "completed_at_epoch": "bigint", "query_count": "bigint", "owned_pages_scoreable": "bigint",
    "owned_query_mapped_unique": "bigint", "query_portfolio_id": "string", "ai_hygiene": "string",
}


def is_report_ready() -> Column:
    return (
        F.coalesce("dashboard_ready", F.lit(True))
        & F.lower(text_or_empty("stage")).isin(*REPORT_READY_STAGES)
        & F.lower(text_or_empty("status")).isin(*SUCCESS_STATES)
    )


def has_report_payload(sizes: dict[str, Column]) -> Column:
    """Any recognised report list is non-empty. ``sizes`` maps list names to their sizes."""
    out = F.lit(False)
    for name in REPORT_LISTS:
        if name in sizes:
            out = out | (F.coalesce(sizes[name], F.lit(0)) > 0)
    return out


def recency() -> Column:
    """completed_at, else created_at, else 0; zero counts as missing."""
    return F.coalesce(F.nullif("completed_at_epoch", F.lit(0)), F.nullif("created_at_epoch", F.lit(0)), F.lit(0)).cast("bigint")


def keyed_manifests(manifests: DataFrame) -> DataFrame:
    m = ensure_columns(manifests, **_MANIFEST)
    return m.withColumns({
        "brand_key": U.registry_key("brand"), "market_key": U.registry_key("market"), "domain_key": U.registry_key("domain"),
    })


def latest_successful(manifests: DataFrame) -> DataFrame:
    """Newest report-ready run per (brand, market) and per (brand, market, domain).

    One pass with grouping sets; ``domain_key`` is NULL on market-level pointers.
    """
    m = keyed_manifests(manifests).where(
        is_report_ready() & (text_or_empty("brand") != "") & (text_or_empty("market") != "")
    ).withColumn("_rank", F.struct(recency().alias("t"), F.col("run_id").alias("r")))
    grouped = m.groupingSets(
        [[F.col("brand_key"), F.col("market_key")], [F.col("brand_key"), F.col("market_key"), F.col("domain_key")]],
        F.col("brand_key"), F.col("market_key"), F.col("domain_key"),
    ).agg(
        F.max_by("run_id", "_rank").alias("run_id"), F.max(recency()).alias("recency"),
        F.grouping_id().alias("_level"),
    )
    return grouped.where("_level != 0 OR domain_key != ''").select(
        "brand_key", "market_key", "domain_key", "run_id", "recency",
        F.when(F.col("_level") == 0, "domain").otherwise("market").alias("level"),
    )


def _wanted(column: str, value: str | None) -> Column:
    if not value or value.lower() == "all":
        return F.lit(True)
    return F.col(column) == U.registry_key(F.lit(value))


def scan_latest(manifests: DataFrame, brand=None, market=None, domain=None) -> DataFrame:
    """The newest report-ready run for the filters; a run without domain matches any domain."""
    m = keyed_manifests(manifests).where(is_report_ready() & _wanted("brand_key", brand) & _wanted("market_key", market))
    if domain:
        m = m.where((F.col("domain_key") == "") | _wanted("domain_key", domain))
    return m.orderBy(F.desc(recency()), F.desc("run_id")).limit(1)


def resolve_latest(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """For each request (brand, market, domain): domain pointer, market pointer, else scan.

    Only runs with ``has_payload`` count. The three candidates carry a priority and the best
    one per request wins; requests are keyed by ``request_id``. The scan is that of ``scan_latest``: a blank or ``all``
    brand or market fits every run, and a run without domain fits every domain.
    """
    usable = manifests.where(F.coalesce("has_payload", F.lit(True)))
    pointers = latest_successful(usable)
    wanted = wanted_keys(requests)
    by_domain = wanted.where("_domain != ''").join(
        pointers.where("level = 'domain'").withColumnRenamed("domain_key", "_domain"), ["brand_key", "market_key", "_domain"]
    ).select("request_id", "run_id", F.lit(0).alias("prio"))
    by_market = wanted.join(
        pointers.where("level = 'market'"), ["brand_key", "market_key"]
    ).select("request_id", "run_id", F.lit(1).alias("prio"))
    best = by_domain.unionByName(by_market).unionByName(_scanned(wanted, usable)).groupBy("request_id").agg(
        F.min_by("run_id", "prio").alias("run_id"), F.min("prio").alias("prio")
    )
    matched = F.when(F.col("prio") == 0, "domain").when(F.col("prio") == 1, "market").otherwise("scan")
    return best.withColumn("matched_by", matched).drop("prio")


def wanted_keys(requests: DataFrame) -> DataFrame:
    """Requests (request_id, brand, market, domain) with their keys and with what they leave open."""
    any_of = lambda c: (text_or_empty(c) == "") | (F.lower(text_or_empty(c)) == "all")
    return requests.select(
        "request_id", U.registry_key("brand").alias("brand_key"), U.registry_key("market").alias("market_key"),
        U.registry_key("domain").alias("_domain"), any_of("brand").alias("_any_brand"), any_of("market").alias("_any_market"),
        (text_or_empty("domain") != "").alias("_by_domain"), any_of("domain").alias("_any_domain"),
    )


def scan_for_requests(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """(request_id, run_id): what ``scan_latest`` finds for each request that finds anything."""
    return _scanned(wanted_keys(requests), manifests).drop("prio")


def _scanned(wanted: DataFrame, usable: DataFrame) -> DataFrame:
    """Per request the run that a scan finds, by aggregations of the runs for each kind of request.

    A request asks for brand and market, one of them or neither; each kind joins the newest run of its keys, of any domain
    or of the request's own and none.
    """
    m = keyed_manifests(usable).where(is_report_ready())
    newest = F.max(F.struct(recency().alias("t"), F.col("run_id").alias("r"))).alias("_found")
    arms = []
    for any_brand in (False, True):
        for any_market in (False, True):
            keys = ([] if any_brand else ["brand_key"]) + ([] if any_market else ["market_key"])
            asked = wanted.where((F.col("_any_brand") == any_brand) & (F.col("_any_market") == any_market))
            every = asked.where(~F.col("_by_domain") | F.col("_any_domain"))
            own = asked.where(F.col("_by_domain") & ~F.col("_any_domain"))
            either = own.select("request_id", *keys, F.explode(F.array_distinct(F.array("_domain", F.lit("")))).alias("domain_key"))
            for rows, by in ((every, keys), (either, [*keys, "domain_key"])):
                found = m.groupBy(*by).agg(newest).where("_found IS NOT NULL")
                arms.append((rows.join(found, by) if by else rows.crossJoin(found)).select("request_id", "_found"))
    both = functools.reduce(DataFrame.unionByName, arms)
    return both.groupBy("request_id").agg(F.max("_found")["r"].alias("run_id"), F.lit(2).alias("prio"))


def history(manifests: DataFrame, statuses: DataFrame, brand=None, market=None, domain=None, limit: int = 20) -> DataFrame:
    """Report-ready runs with their status, newest first, the first ``limit``."""
    m = keyed_manifests(manifests).where(is_report_ready() & _wanted("brand_key", brand) & _wanted("market_key", market))
    if domain:
        m = m.where((F.col("domain_key") == "") | _wanted("domain_key", domain))
    newest = m.orderBy(F.desc(recency()), F.desc("run_id")).limit(max(1, int(limit or 20)))
    s = ensure_columns(
        statuses, run_id="string", brand="string", market="string", domain="string", stage="string", status="string",
        created_at_epoch="bigint", started_at_epoch="bigint", completed_at_epoch="bigint", query_count="bigint",
        owned_pages_scoreable="bigint", owned_query_mapped_unique="bigint", crawl_success_rate="double",
        owned_inventory_selected="bigint", owned_url_count="bigint", external_pages_scoreable="bigint",
        external_citation_count="bigint", serpapi_citation_count="bigint", serpapi_query_count="bigint", serpapi_rows="bigint",
        run_serpapi="boolean", crawl_owned="boolean", owned_pages_attempted="bigint", crawl_external="boolean",
        external_pages_attempted="bigint", query_portfolio_id="string", source_run_id="string", ai_hygiene="string",
    )
    s = s.select("run_id", *[F.col(c).alias(f"s_{c}") for c in s.columns if c != "run_id"])
    j = newest.join(s, "run_id", "left")
    given = lambda first, second: F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    number = lambda first, second: F.coalesce(F.nullif(first, F.lit(0)), F.nullif(second, F.lit(0)))
    asked = lambda flag, tried: F.coalesce(F.col(flag), F.lit(False)) | (F.coalesce(tried, F.lit(0)) > 0)
    return j.select(
        "run_id",
        given("brand", "s_brand").alias("brand"), given("market", "s_market").alias("market"),
        given("domain", "s_domain").alias("domain"),
        given("s_stage", "stage").alias("stage"), given("s_status", "status").alias("status"),
        F.coalesce("dashboard_ready", F.lit(True)).alias("dashboard_ready"),
        F.coalesce(number("created_at_epoch", "s_created_at_epoch"), F.col("s_started_at_epoch")).alias("created_at_epoch"),
        number("completed_at_epoch", "s_completed_at_epoch").alias("completed_at_epoch"),
        number("s_query_count", "query_count").alias("query_count"),
        number("s_owned_pages_scoreable", "owned_pages_scoreable").alias("owned_pages_scoreable"),
        number("s_owned_query_mapped_unique", "owned_query_mapped_unique").alias("owned_query_mapped_unique"),
        number("s_owned_inventory_selected", "s_owned_url_count").alias("owned_inventory_selected"),
        F.col("s_external_pages_scoreable").alias("external_pages_scoreable"),
        number("s_external_citation_count", "s_serpapi_citation_count").alias("citation_count"),
        F.coalesce("s_run_serpapi", F.lit(False)).alias("serpapi_enabled"),
        number("s_serpapi_query_count", "s_serpapi_rows").alias("serpapi_query_count"),
        asked("s_crawl_owned", "s_owned_pages_attempted").alias("crawl_owned"),
        asked("s_crawl_external", "s_external_pages_attempted").alias("crawl_external"),
        F.col("s_crawl_success_rate").alias("crawl_success_rate"),
        given("s_query_portfolio_id", "query_portfolio_id").alias("portfolio_id"),
        F.col("s_source_run_id").alias("source_run_id"),
        given("ai_hygiene", "s_ai_hygiene").alias("ai_hygiene"),
        F.concat(
            F.coalesce(given("brand", "s_brand"), F.lit("Brand")), F.lit(" / "),
            F.coalesce(given("market", "s_market"), F.lit("Market")), F.lit(" — "), F.col("run_id"),
        ).alias("label"),
    ).orderBy(F.desc(recency()), F.desc("run_id"))


def completeness(artifacts: DataFrame, runs: DataFrame | None = None, expected=REQUIRED_ARTIFACTS) -> DataFrame:
    """Missing artifacts and ready/incomplete per run; one aggregation over (run_id, artifact).

    The expected names are seven constants, so no product of runs and names is formed.
    """
    known = F.array(*[F.lit(n) for n in sorted(expected)])
    present = artifacts.where(F.col("artifact").isin(*expected))
    rows = present.select("run_id", "artifact")
    if runs is not None:
        rows = rows.unionByName(runs.select("run_id", F.lit(None).cast("string").alias("artifact")))
    return rows.groupBy("run_id").agg(F.collect_set("artifact").alias("_present")).select(
        "run_id",
        F.array_except(known, "_present").alias("missing"),
        F.when(F.size(F.array_except(known, "_present")) == 0, "ready").otherwise("incomplete").alias("status"),
    )


def manifest_counts(queries: DataFrame, readiness_rows: DataFrame, citations: DataFrame, run: str = "run_id") -> DataFrame:
    """Query, scoreable page, mapped page and citation counts per run: three small aggregates."""
    q = queries.groupBy(run).agg(F.count("*").alias("query_count"))
    p = readiness_rows.groupBy(run).agg(
        F.count("*").alias("owned_pages_scoreable"), F.count_if("query_mapped").alias("owned_query_mapped_unique")
    )
    c = citations.groupBy(run).agg(F.count("*").alias("source_citation_count"))
    joined = q.join(p, run, "full_outer").join(c, run, "full_outer")
    return joined.na.fill(0)


def retention_plan(runs: DataFrame, keep: DataFrame, delete: DataFrame | None = None) -> DataFrame:
    """What a cleanup would do: (delete list or all) minus the keep list."""
    candidates = runs.select("run_id")
    if delete is not None:
        candidates = candidates.join(delete.select("run_id").distinct(), "run_id", "left_semi")
    kept = keep.select("run_id").distinct().withColumn("_kept", F.lit(True))
    return candidates.join(kept, "run_id", "left").select(
        "run_id", F.when(F.col("_kept"), "kept").otherwise("delete").alias("action")
    )


def without_runs(rows: DataFrame, removed: DataFrame) -> DataFrame:
    return rows.join(removed.select("run_id").distinct(), "run_id", "left_anti")


def with_bundle_metadata(bundles: DataFrame) -> DataFrame:
    """run_id, brand, market, domain from the top level, else ``meta``, else ``executive``."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    return bundles.withColumns({
        "run_id": pick("run_id", "meta.run_id"),
        "brand": pick("brand", "meta.brand", "executive.brand"),
        "market": pick("market", "meta.market", "executive.market"),
        "domain": pick("domain", "meta.domain"),
    })


def lookup_status(run_ids: DataFrame, registry: DataFrame, copies: DataFrame) -> DataFrame:
    """Status of each run from the registry, else from the copy kept with the run."""
    r = registry.select("run_id", F.col("status").alias("_r"))
    c = copies.select("run_id", F.col("status").alias("_c"))
    return run_ids.join(r, "run_id", "left").join(c, "run_id", "left").select(
        "run_id", F.coalesce("_r", "_c").alias("status"),
        F.when(F.col("_r").isNotNull(), "registry").when(F.col("_c").isNotNull(), "run_copy").alias("found_in"),
    )


def latest_run(manifests: DataFrame, brand: str, market: str) -> DataFrame:
    return scan_latest(manifests, brand, market)


def current_configs(history_rows: DataFrame, payload) -> DataFrame:
    """Brand configurations after upserts: first id and creation kept, newest payload.

    ``history_rows``: config_id, brand, market, updated_at, payload columns; one row per save.
    """
    h = history_rows.withColumn("config_key", U.brand_market_key("brand", "market"))
    newest = F.max_by(F.struct("brand", "market", *payload), F.struct("updated_at", "config_id")).alias("_p")
    out = h.groupBy("config_key").agg(
        F.min_by("config_id", F.struct("updated_at", "config_id")).alias("config_id"),
        F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"), newest,
    )
    return out.select("config_key", "config_id", "_p.*", "created_at", "updated_at")


def list_configs(configs: DataFrame, brand=None, market=None) -> DataFrame:
    rows = configs.where((text_or_empty("brand") != "") & (text_or_empty("market") != ""))
    if brand:
        rows = rows.where(U.registry_key("brand") == U.registry_key(F.lit(brand)))
    if market:
        rows = rows.where(U.registry_key("market") == U.registry_key(F.lit(market)))
    return rows.orderBy(F.lower("brand"), F.lower("market"))


def delete_configs(configs: DataFrame, removed: DataFrame) -> DataFrame:
    gone = removed.select(U.brand_market_key("brand", "market").alias("config_key")).distinct()
    return configs.join(gone, "config_key", "left_anti")


def recent_portfolios(portfolios: DataFrame, requests: DataFrame, min_created: int | None = None) -> DataFrame:
    """Best usable portfolio per request: exact domain first, then newest, then id.

    Usable: has queries and topics, and is not known to be older than ``min_created``.
    """
    usable = portfolios.where((F.col("query_count") > 0) & (F.col("topic_count") > 0))
    if min_created is not None:
        created = F.coalesce("created_at_epoch", F.lit(0))
        usable = usable.where((created == 0) | (created >= min_created))
    p = usable.select(
        U.registry_key("brand").alias("_b"), U.registry_key("market").alias("_m"), U.registry_key("domain").alias("_d"),
        "portfolio_id", F.coalesce("created_at_epoch", F.lit(0)).alias("created_at_epoch"),
    )
    r = requests.select(
        "request_id", U.registry_key("brand").alias("_b"), U.registry_key("market").alias("_m"), U.registry_key("domain").alias("_want"),
    )
    # one candidate per (brand, market, domain) first, so a request meets few rows
    per_domain = p.groupBy("_b", "_m", "_d").agg(
        F.max_by(F.struct("portfolio_id", "created_at_epoch"), F.struct("created_at_epoch", "portfolio_id")).alias("_p")
    )
    newest = per_domain.groupBy("_b", "_m").agg(
        F.max_by("_p", F.struct("_p.created_at_epoch", "_p.portfolio_id")).alias("_any")
    )
    exact = per_domain.select("_b", "_m", F.col("_d").alias("_want"), F.col("_p").alias("_exact"))
    j = r.join(newest, ["_b", "_m"]).join(exact.where("_want != ''"), ["_b", "_m", "_want"], "left")
    return j.select(
        "request_id", F.coalesce("_exact", "_any")["portfolio_id"].alias("portfolio_id"),
        F.coalesce("_exact", "_any")["created_at_epoch"].alias("created_at_epoch"),
        F.col("_exact").isNotNull().alias("domain_match"),
    )


def store_portfolios(existing: DataFrame, new: DataFrame, now_epoch: Column) -> DataFrame:
    """Append portfolios with id, version and creation time filled in."""
    pid = F.coalesce(
        F.nullif("portfolio_id", F.lit("")),
        F.concat(F.lit("portfolio_"), U.registry_key("brand"), F.lit("_"), U.registry_key("market"), F.lit("_"),
                 now_epoch.cast("string"), F.lit("_"), F.substring(F.sha1(F.concat_ws("|", "brand", "market", "domain")), 1, 6)),
    )
    filled = new.withColumns({
        "portfolio_id": pid,
        "schema_version": F.coalesce(F.nullif("schema_version", F.lit("")), F.lit("brand_topic_query_portfolio.v1")),
        "created_at_epoch": now_epoch,
    })
    return existing.unionByName(filled, allowMissingColumns=True)


def latest_portfolios(portfolios: DataFrame) -> DataFrame:
    """Newest portfolio under each of its two keys: brand+market and brand+market+domain."""
    keys = F.array_distinct(F.array_compact(F.array(
        U.brand_market_key("brand", "market"),
        F.when(text_or_empty("domain") != "", U.brand_market_key("brand", "market", "domain")),
    )))
    rows = portfolios.select(F.explode(keys).alias("latest_key"), "portfolio_id", "created_at_epoch")
    return rows.groupBy("latest_key").agg(
        F.max_by("portfolio_id", F.struct("created_at_epoch", "portfolio_id")).alias("portfolio_id"),
        F.max("created_at_epoch").alias("created_at_epoch"),
    )


def newest_runs(rows: DataFrame, limit: int, keys=("brand_key", "market_key")) -> DataFrame:
    return first_n(rows, list(keys), [F.desc("recency"), F.desc("run_id")], max(1, limit))
