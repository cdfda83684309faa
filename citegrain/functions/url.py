"""URL column functions. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from citegrain.functions import patterns as P
from citegrain.functions.text import strip_ws

# Second-level labels under which three labels make a site.
SECOND_LEVEL_LABELS = ("co", "ac", "go", "or", "ne")

# Well-known pages tried when a site has no inventory.
FALLBACK_PATHS = (
    "/", "/vehicles/", "/ev/", "/dealers/", "/service/", "/purchase/", "/afterservice/", "/news/",
)

# Common sitemap locations.
SITEMAP_PATHS = (
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml",
    "/index.pages-sitemap.xml",
)

# Market name to two-letter search region.
MARKET_REGIONS = {
    "japan": "jp", "usa": "us", "united states": "us", "us": "us",
    "uk": "gb", "united kingdom": "gb", "germany": "de", "france": "fr",
    "italy": "it", "spain": "es", "canada": "ca", "australia": "au",
    "india": "in", "china": "cn", "south korea": "kr", "korea": "kr",
    "brazil": "br", "mexico": "mx", "netherlands": "nl", "sweden": "se",
    "norway": "no", "denmark": "dk", "finland": "fi", "switzerland": "ch",
    "austria": "at", "belgium": "be", "portugal": "pt", "poland": "pl",
    "thailand": "th", "indonesia": "id", "malaysia": "my", "singapore": "sg",
    "philippines": "ph", "vietnam": "vn", "taiwan": "tw", "turkey": "tr",
    "saudi arabia": "sa", "uae": "ae", "south africa": "za", "nigeria": "ng",
    "egypt": "eg", "israel": "il", "new zealand": "nz", "ireland": "ie",
    "czech republic": "cz", "romania": "ro", "hungary": "hu", "greece": "gr",
    "argentina": "ar", "chile": "cl", "colombia": "co", "peru": "pe",
    "global": "us",
}
DEFAULT_REGION = "us"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def drop_fragment(c: Column | str) -> Column:
    return F.substring_index(col(c), "#", 1)


def valid_url(c: Column | str) -> Column:
    """The URL without fragment when absolute http(s) with a host, else NULL."""
    url = strip_ws(col(c))
    return F.when(url.rlike(P.ABSOLUTE_URL), drop_fragment(url))


def loose_url(c: Column | str) -> Column:
    return strip_ws(drop_fragment(_text(c)))


def is_valid_url(c: Column | str) -> Column:
    return _text(c).rlike("(?i)" + P.ABSOLUTE_URL)


def url_key(c: Column | str) -> Column:
    """Comparison key: no fragment, no trailing slashes, lower case."""
    return F.lower(F.regexp_replace(drop_fragment(strip_ws(_text(c))), "/+$", ""))


def authority(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_text(c), P.URL_AUTHORITY, 1))


def host(c: Column | str) -> Column:
    """Authority without a leading ``www.``: the canonical host."""
    return F.regexp_replace(authority(c), r"^www\.", "")


def host_without_default_port(c: Column | str) -> Column:
    return F.regexp_replace(authority(c), ":(?:443|80)$", "")


def path(c: Column | str) -> Column:
    return F.regexp_extract(_text(c), P.URL_PATH, 1)


def site_domain(host_col: Column | str) -> Column:
    """Last two labels of a host, three under labels such as ``co``."""
    h = F.regexp_replace(F.lower(_text(host_col)), r"^\.+|\.+$", "")
    labels = F.split(h, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    return (
        F.when(n <= 2, h)
        .when(F.get(labels, n - 2).isin(*SECOND_LEVEL_LABELS), last(3))
        .otherwise(last(2))
    )


def normalize_url(c: Column | str, strip_query: bool = False) -> Column:
    """Default scheme, lower host, no trailing path slash, no params or fragment."""
    url = strip_ws(_text(c))
    scheme = F.lower(F.regexp_extract(url, P.URL_SCHEME, 1))
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    netloc = authority(url)
    raw_path = F.regexp_replace(path(url), r";[^/]*$", "")
    clean_path = F.when(raw_path == "/", raw_path).otherwise(F.regexp_replace(raw_path, "/+$", ""))
    slashes = F.when((netloc != "") | (clean_path == "") | clean_path.startswith("/"), "//").otherwise("")
    query = F.regexp_extract(url, P.URL_QUERY, 1)
    tail = F.lit("") if strip_query else F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    return F.when(_text(c) == "", "").otherwise(F.concat(scheme, F.lit(":"), slashes, netloc, clean_path, tail))


def base_url(c: Column | str) -> Column:
    """``scheme://host`` or NULL."""
    url = strip_ws(_text(c))
    scheme = F.lower(F.regexp_extract(url, P.URL_SCHEME, 1))
    netloc = F.regexp_extract(url, P.URL_AUTHORITY, 1)
    return F.when((scheme != "") & (netloc != ""), F.concat(scheme, F.lit("://"), netloc))


def base_variants(c: Column | str) -> Column:
    """The base of a domain plus ``www3`` and ``www2`` forms of a ``www`` host, in order."""
    base = base_url(c)
    is_www = base.rlike(r"^[^:]+://www\.")
    swap = lambda label: F.when(is_www, F.regexp_replace(base, r"://www\.", f"://{label}."))
    return F.array_compact(F.array(base, swap("www3"), swap("www2")))


def url_tokens(c: Column | str) -> Column:
    raw = F.lower(F.concat(authority(c), F.lit(" "), path(c)))
    return F.array_distinct(
        F.filter(F.split(raw, f"[^{P.TOKEN_CHARS}{P.PROLONGED_MARK}]+"), lambda t: t != "")
    )


def is_pdf_url(c: Column | str) -> Column:
    return F.lower(path(c)).endswith(".pdf")


def safe_slug(c: Column | str, max_len: int = 80) -> Column:
    slug = F.lower(F.regexp_replace(F.regexp_replace(_text(c), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(slug == "", "item").otherwise(F.left(slug, F.lit(max_len)))


def file_slug(c: Column | str) -> Column:
    """Readable host and path followed by ten digits of the URL's SHA-1."""
    joined = F.regexp_replace(
        F.concat(F.regexp_extract(_text(c), P.URL_AUTHORITY, 1), F.lit("_"), path(c)), "^_+|_+$", ""
    )
    base = F.left(F.regexp_replace(joined, "[^a-zA-Z0-9]+", "_"), F.lit(90))
    digest = F.left(F.sha1(_text(c)), F.lit(10))
    return F.concat(F.when(base == "", safe_slug(c)).otherwise(base), F.lit("_"), digest)


def first_url(*columns: Column | str) -> Column:
    """First non-empty URL among alias columns, as text, '' when none."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns], F.lit(""))


def host_suffixes(host_col: Column | str) -> Column:
    """``a.b.c`` → [a.b.c, b.c, c]: the keys that turn a suffix match into an equi-join."""
    labels = F.split(_text(host_col), r"\.")
    return F.transform(
        labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    )


def matches_any_domain(host_col: Column | str, domains) -> Column:
    """Host equals a domain or is below it. ``domains`` is a list or an array column."""
    h = F.lower(_text(host_col))
    if isinstance(domains, (list, tuple, set)):
        domains = F.array(*[F.lit(d.lower()) for d in sorted(domains)]) if domains else F.array().cast("array<string>")
    return F.exists(domains, lambda d: (h == F.lower(d)) | h.endswith(F.concat(F.lit("."), F.lower(d))))


def owned_domain_forms(domain: Column | str) -> Column:
    """Configured domain → the stored form, the bare form and the ``www.`` form."""
    d = F.lower(strip_ws(_text(domain)))
    d = F.when(d.rlike("^https?://"), F.regexp_extract(d, P.URL_AUTHORITY, 1)).otherwise(d)
    bare = F.regexp_replace(d, r"^www\.", "")
    return F.when(d == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array(d, bare, F.concat(F.lit("www."), bare)))
    )


def fallback_urls(domain: Column | str) -> Column:
    base = F.regexp_replace(_text(domain), "/+$", "")
    return F.when(base == "", F.array().cast("array<string>")).otherwise(
        F.array(*[F.concat(base, F.lit(p)) for p in FALLBACK_PATHS])
    )


def market_region(market: Column | str) -> Column:
    """Two-letter search region of a market name; two letters pass through."""
    key = F.lower(strip_ws(_text(market)))
    table = F.str_to_map(F.lit("|".join(f"{k}={v}" for k, v in MARKET_REGIONS.items())), F.lit(r"\|"), F.lit("="))
    return F.when(key.rlike(r"^\p{L}{2}$"), key).otherwise(
        F.coalesce(F.try_element_at(table, key), F.lit(DEFAULT_REGION))
    )


def registry_key(c: Column | str) -> Column:
    """Trimmed lower-case key with schemes removed and ``/``, blank, ``:`` as ``_``."""
    key = F.lower(strip_ws(_text(c)))
    key = F.replace(F.replace(key, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.translate(key, "/ :", "___")


def brand_market_key(brand: Column | str, market: Column | str, domain: Column | str | None = None) -> Column:
    part = lambda c, default: registry_key(F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default)))
    parts = [part(brand, "unknown_brand"), part(market, "unknown_market")]
    if domain is not None:
        parts.append(F.when(_text(domain) != "", registry_key(domain)))
    return F.concat_ws("__", *parts)
