"""URL, market and key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import MARKETS_SQL, OWNED, in_list, key_sql, market_of, query, quoted, table
from citegrain.functions import patterns as P
from citegrain.functions import url as U
from citegrain.operators import classify, dedupe, hygiene

TRIM = f"regexp_replace(url, '^{P.WS}+|{P.WS}+$', '', 'g')"
AUTH = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
HOST = rf"regexp_replace({AUTH}, '^www\.', '')"
PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
TOKEN_SPLIT = f"[^{P.TOKEN_CHARS}{P.PROLONGED_MARK}]+"


@query(rf"""
SELECT page_id,
       CASE WHEN regexp_matches({TRIM}, '^https?://[^/?#]+') THEN split_part({TRIM}, '#', 1) END AS valid_url,
       {TRIM.replace('url', "split_part(url, '#', 1)", 1)} AS loose_url,
       lower(regexp_replace(split_part({TRIM}, '#', 1), '/+$', '')) AS url_key,
       regexp_matches(url, '^https?://[^/?#]+') AS is_valid,
       regexp_extract(url, '^([a-z]+):', 1) || '://' || {AUTH}
         || CASE WHEN {PATH} = '/' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END
         || CASE WHEN regexp_matches(url, '\?') THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS normal_url,
       regexp_extract(url, '^([a-z]+):', 1) || '://' || {AUTH}
         || CASE WHEN {PATH} = '/' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END AS normal_url_bare
FROM pages""")
def url_normalise(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.valid_url("url").alias("valid_url"), U.loose_url("url").alias("loose_url"),
        U.url_key("url").alias("url_key"), U.is_valid_url("url").alias("is_valid"),
        U.normalize_url("url").alias("normal_url"), U.normalize_url("url", strip_query=True).alias("normal_url_bare"),
    )


@query(rf"""
WITH p AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '' ELSE '' END AS url FROM pages),
h AS (SELECT page_id, {AUTH} AS authority, {HOST} AS host FROM p)
SELECT page_id, authority, host, regexp_replace(authority, ':(443|80)$', '') AS host_without_port,
       CASE WHEN len(string_split(host, '.')) <= 2 THEN host
            WHEN string_split(host, '.')[-2] IN ('co','ac','go','or','ne') THEN array_to_string(string_split(host, '.')[-3:], '.')
            ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS site_domain
FROM h""")
def url_hosts(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.authority("url").alias("authority"), U.host("url").alias("host"),
        U.host_without_default_port("url").alias("host_without_port"), U.site_domain(U.host("url")).alias("site_domain"),
    )


@query(rf"""
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(
         string_split_regex(lower({AUTH} || ' ' || {PATH}), '{TOKEN_SPLIT}'), lambda t: t <> ''))), ' ') AS tokens
FROM pages""")
def url_tokens(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.array_join(F.array_sort(U.url_tokens("url")), " ").alias("tokens")
    )


@query(rf"""
SELECT page_id, lower({PATH}) LIKE '%.pdf' AS is_pdf,
       left(regexp_replace(regexp_replace({AUTH} || '_' || {PATH}, '^_+|_+$', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), 90)
         || '_' || left(sha1(url), 10) AS file_slug,
       left(lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 80) AS safe_slug
FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN split_part(url, '?', 1) || '.PDF' ELSE url END AS url FROM pages)""")
def url_slugs(spark, sf):
    p = table(spark, sf, "pages").withColumn(
        "url", F.when(F.col("page_id") % 5 == 0, F.concat(F.substring_index("url", "?", 1), F.lit(".PDF"))).otherwise(F.col("url"))
    )
    return p.select("page_id", U.is_pdf_url("url").alias("is_pdf"), U.file_slug("url").alias("file_slug"), U.safe_slug("url").alias("safe_slug"))


@query(rf"""
WITH b AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)
SELECT page_id, 0 AS pos, scheme || '://' || h AS base FROM b
UNION ALL SELECT page_id, 1, scheme || '://www3.' || substr(h, 5) FROM b WHERE h LIKE 'www.%'
UNION ALL SELECT page_id, 2, scheme || '://www2.' || substr(h, 5) FROM b WHERE h LIKE 'www.%'""")
def url_base_variants(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(U.base_variants("url")).alias("pos", "base"))


@query(rf"""
WITH d AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base FROM pages),
     paths AS (SELECT * FROM (VALUES {", ".join(f"({quoted(p)})" for p in U.FALLBACK_PATHS)}) t(path))
SELECT base, base || path AS url FROM d, paths""")
def fallback_pages(spark, sf):
    bases = table(spark, sf, "pages").select(U.base_url("url").alias("base")).distinct()
    return bases.select("base", F.explode(U.fallback_urls("base")).alias("url"))


@query(rf"""
SELECT page_id, list_max(list_transform([{in_list(OWNED)}], lambda d:
         CASE WHEN {AUTH} = d OR {AUTH} LIKE '%.' || d THEN 1 ELSE 0 END)) = 1 AS is_owned
FROM pages""")
def owned_split(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.matches_any_domain(U.authority("url"), list(OWNED)).alias("is_owned")
    )


LANG = r"regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1)"


@query(rf"""
WITH p AS (SELECT page_id, url, {LANG} AS run_id, {AUTH} AS authority FROM pages),
d AS (SELECT DISTINCT run_id, array_to_string(string_split(authority, '.')[-2:], '.') AS domain FROM p
      WHERE page_id % 2 = 0 AND authority NOT LIKE '%.net'),
forms AS (SELECT run_id, domain FROM d UNION SELECT run_id, 'www.' || domain FROM d)
SELECT p.run_id, p.page_id, EXISTS (SELECT 1 FROM forms f WHERE f.run_id = p.run_id
         AND (p.authority = f.domain OR p.authority LIKE '%.' || f.domain)) AS is_owned
FROM p""")
def owned_domain_join(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1).alias("run_id"))
    configured = p.where((F.col("page_id") % 2 == 0) & ~U.authority("url").endswith(".net")).select(
        "run_id", U.site_domain(U.authority("url")).alias("domain")
    ).distinct()
    owned = dedupe.split_owned(p, dedupe.owned_domains(configured))
    return owned.select("run_id", "page_id", "is_owned")


REGION_MAP = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in U.MARKET_REGIONS.items()) + "}"


@query(rf"""
WITH m AS (
  SELECT 'customer' AS kind, c_custkey AS id, ({MARKETS_SQL})[c_nationkey + 1] AS market FROM customer
  UNION ALL SELECT 'document', doc_id, lang FROM documents)
SELECT kind, id, market,
       CASE WHEN regexp_matches(lower(trim(market)), '^[a-z]{{2}}$') THEN lower(trim(market))
            ELSE coalesce(({REGION_MAP})[lower(trim(market))], 'us') END AS region
FROM m""")
def market_regions(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), market_of("c_nationkey").alias("market"))
    d = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("lang").alias("market"))
    return c.unionByName(d).withColumn("region", U.market_region("market"))


@query(rf"""
WITH c AS (SELECT c_custkey, c_mktsegment AS brand, ({MARKETS_SQL})[c_nationkey + 1] AS market,
                  CASE WHEN c_custkey % 2 = 0 THEN 'https://' || c_name || ':8080/a b' ELSE '' END AS domain FROM customer)
SELECT c_custkey, {key_sql('domain')} AS domain_key,
       {key_sql('brand')} || '__' || {key_sql("coalesce(nullif(market, ''), 'unknown_market')")}
       || CASE WHEN domain <> '' THEN '__' || {key_sql('domain')} ELSE '' END AS registry_key
FROM c""")
def registry_keys(spark, sf):
    c = table(spark, sf, "customer").withColumns({
        "market": market_of("c_nationkey"),
        "domain": F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://"), "c_name", F.lit(":8080/a b"))).otherwise(""),
    })
    return c.select(
        "c_custkey", U.registry_key("domain").alias("domain_key"),
        U.brand_market_key("c_mktsegment", "market", "domain").alias("registry_key"),
    )


# --- classes -----------------------------------------------------------------------------

SITE_WORDS = (
    "reuters", "city-bank", "reddit", "youtube", "kakaku", "evsmart", "topgear", "dealer", "widget", "stanford.edu",
    "shop.example.com", "partner.example.org", "old.example.net", "google",
)


def _sites(spark, sf):
    s = table(spark, sf, "part").withColumn("n", F.col("p_partkey") % len(SITE_WORDS))
    word = F.element_at(F.array(*[F.lit(w) for w in SITE_WORDS]), (F.col("n") + 1).cast("int"))
    return s.select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("source_name"),
        F.concat(F.lit("https://www."), word, F.when(F.contains(word, F.lit(".")), "").otherwise(".com"),
                 F.lit("/product/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("url"),
    )


SITES_SQL = f"""
SELECT p_partkey, p_name AS title, p_brand AS source_name,
       'https://www.' || w || CASE WHEN contains(w, '.') THEN '' ELSE '.com' END || '/product/' || replace(p_name, ' ', '-') AS url
FROM (SELECT *, ([{in_list(SITE_WORDS)}])[p_partkey % {len(SITE_WORDS)} + 1] AS w FROM part)"""
DOMAINS = classify.SourceDomains(owned=("shop.example.com",), ecosystem=("example.org",), off_market=("old.example.net",))
_CASES = "\n".join(f"            WHEN regexp_matches(t, {quoted(p)}) THEN {quoted(n)}" for n, p in classify.SOURCE_PATTERNS)


@query(rf"""
WITH s AS ({SITES_SQL}), h AS (SELECT *, {AUTH} AS host FROM s),
f AS (SELECT *, lower(host || ' ' || source_name || ' ' || title) AS t,
        host = 'shop.example.com' OR host LIKE '%.shop.example.com' AS own,
        host = 'example.org' OR host LIKE '%.example.org' AS eco,
        host = 'old.example.net' OR host LIKE '%.old.example.net' AS off FROM h),
k AS (SELECT *, CASE WHEN own THEN 'owned_brand' WHEN eco THEN 'owned_ecosystem' WHEN off THEN 'off_market_owned'
{_CASES}
            ELSE 'other' END AS source_type FROM f),
q AS (SELECT *, CASE WHEN source_type IN ('forum_community', 'video_social') THEN 'low' WHEN off THEN 'medium'
            WHEN source_type IN ({in_list(classify.HIGH_QUALITY)}) THEN 'high'
            WHEN source_type IN ({in_list(classify.MEDIUM_QUALITY)}) THEN 'medium' ELSE 'low' END AS source_quality FROM k)
SELECT p_partkey, source_type, source_quality, own AS is_owned_domain, eco AS is_owned_ecosystem, off AS is_off_market,
       source_type IN ('forum_community', 'video_social') AS is_social_or_forum, source_type = 'other' AS is_low_authority,
       CASE WHEN p_partkey % 3 = 0 THEN 'low' ELSE source_quality END AS confidence,
       CASE WHEN off THEN 1 ELSE 0 END + CASE WHEN source_type IN ('forum_community', 'video_social') THEN 1 ELSE 0 END
         + CASE WHEN source_type = 'other' THEN 1 ELSE 0 END AS notes
FROM q""")
def source_class(spark, sf):
    s = _sites(spark, sf).withColumn("c", classify.source_class("url", "source_name", "title", DOMAINS))
    return s.select(
        "p_partkey", "c.source_type", "c.source_quality", "c.is_owned_domain", "c.is_owned_ecosystem", "c.is_off_market",
        "c.is_social_or_forum", "c.is_low_authority",
        classify.confidence(F.col("c.source_quality"), F.col("p_partkey") % 3 != 0).alias("confidence"),
        F.size("c.source_quality_notes").alias("notes"),
    )


@query(rf"""
WITH s AS ({SITES_SQL}), h AS (SELECT p_partkey, url, {HOST} AS d FROM s)
SELECT p_partkey, CASE WHEN d = '' THEN 'external_citation' WHEN d = 'shop.example.com' THEN 'owned_oem'
         WHEN regexp_matches(d, 'youtube|reddit|x\.com|twitter|facebook|instagram') THEN 'forum_social_video'
         WHEN regexp_matches(d, 'go\.jp|or\.jp|\.gov|\.edu') THEN 'authority_or_partner'
         WHEN contains(d, 'google') AND contains(lower(url), 'product') THEN 'shopping_result'
         ELSE 'external_citation' END AS source_type
FROM h""")
def source_type(spark, sf):
    return _sites(spark, sf).select(
        "p_partkey", classify.cited_source_type("url", ("www.shop.example.com",)).alias("source_type")
    )


PAGE_WORDS = (
    "comparison/all", "charge/home", "e-power", "interior/seat", "safety", "campaign/spring", "kei/dayz", "faq",
    "vehicles/new/leaf.html", "company", "battery", "warranty", "price-list", "parking", "dealer",
)


@query(rf"""
WITH u AS (SELECT p_partkey, 'https://www.example.com/' || ([{in_list(PAGE_WORDS)}])[p_partkey % {len(PAGE_WORDS)} + 1] AS url, p_name FROM part),
t AS (SELECT p_partkey, lower({PATH}) AS path,
        list_concat(string_split_regex(lower({AUTH} || ' ' || {PATH}), '[^a-z0-9]+'), string_split_regex(lower(p_name), '[^a-z0-9]+')) AS toks FROM u)
SELECT p_partkey, CASE
{chr(10).join(
    "  WHEN " + " OR ".join([f"contains(path, {quoted(f)})" for f in fr] + ([f"list_has_any(toks, [{in_list(ws)}])"] if ws else []))
    + f" THEN {quoted(name)}" for name, fr, ws in classify.PAGE_TYPE_RULES)}
  WHEN regexp_matches(path, '/vehicles/new/[^/]+\.html?$') THEN 'model_overview' ELSE 'other' END AS page_type
FROM t""")
def page_type(spark, sf):
    word = F.element_at(F.array(*[F.lit(w) for w in PAGE_WORDS]), (F.col("p_partkey") % len(PAGE_WORDS) + 1).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", classify.page_type(F.concat(F.lit("https://www.example.com/"), word), F.col("p_name")).alias("page_type")
    )


@query(rf"""
WITH p AS (SELECT {LANG} AS run_id, page_id, url FROM pages),
d AS (SELECT run_id, min(url) AS domain FROM p GROUP BY 1),
b AS (
  SELECT run_id, 0 AS part, 0 AS pos, regexp_extract(domain, '^([a-z]+://[^/?#]*)', 1) AS base FROM d
  UNION ALL SELECT run_id, 0, 1, regexp_replace(regexp_extract(domain, '^([a-z]+://[^/?#]*)', 1), '://www\.', '://www3.') FROM d WHERE regexp_matches(domain, '://www\.')
  UNION ALL SELECT run_id, 0, 2, regexp_replace(regexp_extract(domain, '^([a-z]+://[^/?#]*)', 1), '://www\.', '://www2.') FROM d WHERE regexp_matches(domain, '://www\.')
  UNION ALL SELECT run_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END, page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) FROM p)
SELECT run_id, base, min(part * 1000000000 + pos) AS first_seen FROM b GROUP BY 1, 2""")
def hygiene_bases(spark, sf):
    p = table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1).alias("run_id"), F.col("page_id").alias("pos"), "url"
    )
    domains = p.groupBy("run_id").agg(F.min("url").alias("domain"))
    out = hygiene.base_candidates(domains, p.where("pos % 2 = 0"), p.where("pos % 2 = 1"))
    return out.select("run_id", "base", (F.col("first_seen.part") * F.lit(1000000000) + F.col("first_seen.pos")).cast("bigint").alias("first_seen"))
