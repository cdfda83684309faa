"""Sitemap and robots.txt files that were landed as (site, url, content) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import lines, strip_ws, text_or_empty
from citegrain.operators.frames import first_n, first_wins
from citegrain.session import checkpointed

LOC = r"(?is)<[\w.:-]*loc(?:\s[^>]*)?>([^<]*)</"


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """``Sitemap:`` directives of robots.txt rows (site, content), in line order."""
    rows = files.select("site", F.posexplode(lines("content")).alias("pos", "line"))
    return rows.where(F.lower("line").startswith("sitemap:")).select(
        "site", "pos", strip_ws(F.regexp_replace("line", "^[^:]*:", "")).alias("sitemap_url")
    ).where("sitemap_url != ''")


def sitemap_candidates(sites: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """Sitemap URLs to try per site, ordered distinct: explicit, robots.txt, common places.

    ``sites``: site, domain, explicit_sitemap_url (nullable).
    """
    explicit = sites.select(
        "site", F.lit(0).alias("part"), F.lit(0).alias("pos"), strip_ws("explicit_sitemap_url").alias("sitemap_url")
    )
    paths = F.array(*[F.lit(p) for p in U.SITEMAP_PATHS])
    base = F.regexp_replace(strip_ws(text_or_empty("domain")), "/+$", "")
    swapped = F.slice(U.base_variants("domain"), 2, 2)
    bases = F.when(base == "", F.array().cast("array<string>")).otherwise(
        F.concat(F.array(base), F.coalesce(swapped, F.array().cast("array<string>")))
    )
    common = sites.select("site", F.lit(2).alias("part"), F.posexplode(
        F.flatten(F.transform(bases, lambda b: F.transform(paths, lambda p: F.concat(b, p))))
    ).alias("pos", "sitemap_url"))
    rows = explicit.unionByName(common)
    if robots is not None:
        rows = rows.unionByName(robots.select("site", F.lit(1).alias("part"), "pos", "sitemap_url"))
    unique = first_wins(rows.where("sitemap_url != ''"), ["site", "sitemap_url"], ["part", "pos"])
    return unique.select("site", F.struct("part", "pos").alias("order"), "sitemap_url")


def parse_sitemaps(files: DataFrame) -> DataFrame:
    """Landed files (site, sitemap_url, content) → well-formed flag and every loc in order."""
    markup = F.regexp_replace("content", r"(?s)<!--.*?-->", "")
    markup = F.regexp_replace(markup, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    checked = F.from_xml(
        F.col("content"), f"_corrupt_record string, _any string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    locs = F.filter(
        F.transform(F.regexp_extract_all(markup, F.lit(LOC), F.lit(1)), lambda x: _decode(strip_ws(x))), lambda x: x != ""
    )
    ok = F.col("_x").isNotNull() & F.col("_x._corrupt_record").isNull()
    return files.withColumn("_x", checked).select(
        "site", "sitemap_url", ok.alias("ok"), F.when(ok, locs).otherwise(F.array().cast("array<string>")).alias("locs")
    )


def _decode(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _is_nested(loc: Column) -> Column:
    low = F.lower(loc)
    return low.endswith(".xml") | F.contains(low, F.lit(".xml?"))


def read_order(parsed: DataFrame, candidates: DataFrame, max_expanded: int | None = None) -> DataFrame:
    """The order in which the sitemaps of each site are read: breadth first, each once.

    One round per nesting level, until a level names no new file; a round ranks only the new files
    of a site. With ``max_expanded`` files beyond the first ``max_expanded - 1`` of a site are not
    expanded.
    """
    by_order = lambda *cols: Window.partitionBy("site").orderBy(*cols)
    level = checkpointed(candidates.select(
        "site", "sitemap_url", F.row_number().over(by_order("order")).alias("idx")
    ))
    # only the links between sitemaps are walked; they are extracted once
    links = checkpointed(
        parsed.select("site", "sitemap_url", F.filter(
            F.transform("locs", lambda l, i: F.struct(i.alias("pos"), l.alias("child"))), lambda x: _is_nested(x["child"])
        ).alias("children")).where(F.size("children") > 0)
    )
    known = level
    while True:
        opened = level if max_expanded is None else level.where(F.col("idx") < max_expanded)
        children = opened.join(links, ["site", "sitemap_url"]).select(
            "site", "idx", F.explode("children").alias("c")
        ).select("site", F.col("c.child").alias("sitemap_url"), "idx", "c.pos")
        fresh = first_wins(children, ["site", "sitemap_url"], ["idx", "pos"]).join(
            known.select("site", "sitemap_url"), ["site", "sitemap_url"], "left_anti"
        )
        size = known.groupBy("site").agg(F.max("idx").alias("_size"))
        level = checkpointed(
            fresh.join(size, "site").select(
                "site", "sitemap_url", (F.row_number().over(by_order("idx", "pos")) + F.col("_size")).alias("idx")
            )
        )
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def site_inventory(parsed: DataFrame, order: DataFrame, max_urls: int | None = None, max_expanded: int | None = None):
    """(urls, stats): distinct page URLs per site in order of reading, and figures per sitemap.

    Limits hold only if given: the first ``max_urls`` page URLs of a site, and no expansion from file ``max_expanded`` on.
    """
    read = order.join(parsed, ["site", "sitemap_url"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    expanded = lambda idx: F.lit(True) if max_expanded is None else idx < max_expanded
    is_page = lambda loc, idx: ~(_is_nested(loc) & expanded(idx)) & loc.rlike("^https?://")
    located = read.select("site", "idx", F.posexplode_outer("locs").alias("pos", "url")).where(is_page(F.col("url"), F.col("idx")))
    first = located if max_urls is None else first_n(located, "site", ["idx", "pos"], max_urls, rank="_n").drop("_n")
    unique = first_wins(first, ["site", "url"], ["idx", "pos"])
    # numbers are given per sitemap file and added to the files before, so a site is not ranked in one task
    within = Window.partitionBy("site", "idx").orderBy("pos")
    before = Window.partitionBy("site").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    sizes = unique.groupBy("site", "idx").agg(F.count("*").alias("n"))
    starts = sizes.select("site", "idx", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    urls = unique.withColumn("n", F.row_number().over(within)).join(starts, ["site", "idx"]).select(
        "site", (F.col("start") + F.col("n")).cast("int").alias("pos"), "url"
    )
    page_count = F.size(F.filter(F.coalesce("locs", F.array().cast("array<string>")), lambda l: is_page(l, F.col("idx"))))
    stats = read.select(
        "site", "idx", "sitemap_url", F.when(F.col("ok"), "success").otherwise("error").alias("status"),
        F.coalesce(F.size("locs"), F.lit(0)).alias("loc_count"), page_count.alias("url_count"),
    )
    if max_urls is None:
        return urls, stats
    earlier = Window.partitionBy("site").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("url_count").over(earlier), F.lit(0))).where(
        F.col("_before") < max_urls
    )
    counted = F.least(F.col("url_count"), F.lit(max_urls) - F.col("_before"))
    return urls, stats.withColumn("url_count", counted.cast("int")).drop("_before")


def with_fallback(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites whose sitemaps gave nothing get the well-known pages; ``fallback_used`` tells."""
    empty = sites.join(urls.select("site").distinct(), "site", "left_anti")
    extra = empty.select("site", F.posexplode(U.fallback_urls("domain")).alias("pos", "url")).select(
        "site", (F.col("pos") + 1).alias("pos"), "url", F.lit(True).alias("fallback_used")
    )
    return urls.withColumn("fallback_used", F.lit(False)).unionByName(extra)
