"""Source, page and confidence classes as CASE expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import any_term, constants, keyword_tokens, text_or_empty

# Fixed patterns: source class by host, name and title; the first that matches wins.
SOURCE_PATTERNS = (
    ("authority_body", r"jsae|自動車技術会|spglobal|s&p|\.ac\.jp|go\.jp|\.gov|\.edu|university|standards|regulator|省|庁|機構"),
    ("news_media", r"reuters|nikkei|asahi|yomiuri|bloomberg|press|新聞|news"),
    ("finance_lender", r"bank|finance|loan|leasing|lease|credit|insurance|insurer|ratings"),
    ("forum_community", r"reddit|facebook|forum|community|quora|x\.com|twitter|minkara"),
    ("video_social", r"youtube|youtu\.be|tiktok|instagram"),
    ("marketplace_listing", r"carsensor|goo-net|kakaku|carview|autotrader|marketplace|autocraft|used|listing"),
    ("partner_infrastructure", r"charge|charging|evsmart|eneos|tepco|e-mobility|plug|recharged|eleport|abrp"),
    ("publisher_review", r"motortrend|carsguide|carsales|autocar|carwow|topgear|response\.jp|webcg|bestcar|clicccar|review|car reports|davey|choosemycar|szabo|bambinos|japan wonder travel"),
    ("dealer_retailer", r"dealer|retailer|sales|ucar"),
)
SOCIAL_CLASSES = ("forum_community", "video_social")
HIGH_QUALITY = ("authority_body", "owned_brand", "owned_ecosystem")
MEDIUM_QUALITY = (
    "publisher_review", "partner_infrastructure", "news_media", "finance_lender",
    "marketplace_listing", "dealer_retailer", "competitor_owned",
)
NOTE_OFF_MARKET = "Off-market owned or dealer source; use cautiously for Japan-specific recommendations."
NOTE_SOCIAL = "Social/forum/video source; useful as directional evidence but lower authority."
NOTE_UNSURE = "Source type could not be confidently classified; authority is uncertain."

# Page type by path fragment or token, in order.
PAGE_TYPE_RULES = (
    ("comparison_specs", ("comparison",), ()),
    ("ev_range_charging",
     ("range_and_charging", "cruising-distance", "charge_cruising", "/charge", "/charging"),
     ("battery", "v2h", "charger", "charging")),
    ("powertrain",
     ("e-power", "e_4orce", "e-4orce"),
     ("e-power", "epower", "hybrid", "powertrain", "e-4orce")),
    ("family_practicality",
     ("interior", "seat", "seat_arrangement", "luggage", "storage", "comfort", "loadability", "interior_space"),
     ("isofix", "stroller", "seating")),
    ("safety_trust",
     ("safety", "propilot", "360_safety", "/icc", "/nim"),
     ("adas", "jncap", "warranty")),
    ("finance_value",
     ("/credit", "/subscription", "/subsidy", "/campaign", "/event"),
     ("finance", "loan", "lease", "leasing", "offer", "bvc", "price", "cost")),
    ("urban_mobility",
     ("ease_of_driving", "/kei", "/dayz", "/roox", "/sakura"),
     ("parking", "compact", "urban", "turning")),
    ("ownership_aftersales",
     ("/service", "/maintenance", "/connect", "/faq", "/owners", "maintepro", "/recall"),
     ("dealer", "support", "aftersales", "roadside")),
)
MODEL_PAGE = r"/vehicles/new/[^/]+\.html?$"

# Source type of a cited URL by host fragment.
SOCIAL_HOSTS = ("youtube", "reddit", "x.com", "twitter", "facebook", "instagram")
AUTHORITY_HOSTS = ("go.jp", "or.jp", ".gov", ".edu")


@dataclass(frozen=True)
class SourceDomains:
    """Brand-owned domain lists; configuration, so bounded by what a person writes down."""

    owned: tuple[str, ...] = ()
    ecosystem: tuple[str, ...] = ()
    off_market: tuple[str, ...] = ()


def _any_of(text: Column, fragments) -> Column:
    return any_term(text, fragments)


def _has_token(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, constants(words)) if words else F.lit(False)


def source_class(url, source_name=None, title=None, domains: SourceDomains = SourceDomains()) -> Column:
    """Struct: source_type, source_quality, notes and the five flags."""
    host = U.host_without_default_port(url)
    blank = F.lit("")
    text = F.lower(F.concat_ws(
        " ", host,
        text_or_empty(source_name) if source_name is not None else blank,
        text_or_empty(title) if title is not None else blank,
    ))
    owned = U.matches_any_domain(host, list(domains.owned))
    ecosystem = U.matches_any_domain(host, list(domains.ecosystem))
    off_market = U.matches_any_domain(host, list(domains.off_market))
    kind = F.when(owned, "owned_brand").when(ecosystem, "owned_ecosystem").when(off_market, "off_market_owned")
    for name, pattern in SOURCE_PATTERNS:
        kind = kind.when(text.rlike(pattern), name)
    kind = kind.otherwise("other")
    social = kind.isin(*SOCIAL_CLASSES)
    quality = (
        F.when(social, "low")
        .when(off_market, "medium")
        .when(kind.isin(*HIGH_QUALITY), "high")
        .when(kind.isin(*MEDIUM_QUALITY), "medium")
        .otherwise("low")
    )
    notes = F.array_compact(F.array(
        F.when(off_market, NOTE_OFF_MARKET), F.when(social, NOTE_SOCIAL), F.when(kind == "other", NOTE_UNSURE)
    ))
    return F.struct(
        kind.alias("source_type"), quality.alias("source_quality"), notes.alias("source_quality_notes"),
        owned.alias("is_owned_domain"), ecosystem.alias("is_owned_ecosystem"), off_market.alias("is_off_market"),
        social.alias("is_social_or_forum"), (kind == "other").alias("is_low_authority"),
    )


def confidence(quality, has_crawl=None) -> Column:
    q = F.col(quality) if isinstance(quality, str) else quality
    level = F.when(q == "high", "high").when(q == "medium", "medium").otherwise("low")
    return level if has_crawl is None else F.when(has_crawl, level).otherwise("low")


def cited_source_type(url, owned_domains=()) -> Column:
    """Type of a cited URL: owned, social or video, authority, shopping, other."""
    host = U.host(url)
    low = F.lower(text_or_empty(url))
    owned = [d.lower().removeprefix("www.") for d in owned_domains]
    return (
        F.when(host == "", "external_citation")
        .when(host.isin(*owned) if owned else F.lit(False), "owned_oem")
        .when(_any_of(host, SOCIAL_HOSTS), "forum_social_video")
        .when(_any_of(host, AUTHORITY_HOSTS), "authority_or_partner")
        .when(F.contains(host, F.lit("google")) & F.contains(low, F.lit("product")), "shopping_result")
        .otherwise("external_citation")
    )


def page_type(url, title=None, description=None) -> Column:
    path = F.lower(U.path(url))
    blank = F.lit("")
    tokens = F.array_union(
        U.url_tokens(url),
        keyword_tokens(title if title is not None else blank, description if description is not None else blank),
    )
    kind = None
    for name, fragments, words in PAGE_TYPE_RULES:
        test = _any_of(path, fragments) | _has_token(tokens, words)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.when(path.rlike(MODEL_PAGE), "model_overview").otherwise("other")


def mapping_quality(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 44, "strong").when(s >= 26, "acceptable").otherwise("weak")


def citation_visibility(citation_count) -> Column:
    n = F.col(citation_count) if isinstance(citation_count, str) else citation_count
    return F.when(n > 0, "serpapi_collected_with_citations").otherwise("serpapi_collected_no_citations")
