"""Yes/no and counted evidence signals of a page's Markdown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from citegrain.functions import url as U
from citegrain.functions.markdown import count_of, markdown_metrics
from citegrain.functions.text import any_term, compact_block, let

# Term families, in lower case.
CITATION_TERMS = (
    "source", "citation", "reference", "出典", "参照", "引用", "公式", "によると", "review", "guide", "rating", "調査",
    "データ", "according to",
)
DOMAIN_TERMS = (
    "vehicle", "car", "ev", "electric", "battery", "range", "charging", "hybrid", "fuel", "warranty", "service",
    "maintenance", "finance", "lease", "price", "cost", "safety", "adas", "interior", "seat", "boot", "cargo", "dealer",
    "roadside", "車", "自動車", "電気自動車", "充電", "航続", "バッテリー", "燃費", "保証", "整備", "点検", "価格", "費用", "安全",
    "内装", "座席", "荷室", "販売店",
)
COMPARISON_TERMS = (
    "compare", "comparison", "versus", "vs", "difference", "pros", "cons", "review", "best", "rating", "table", "比較",
    "違い", "メリット", "デメリット", "グレード", "標準装備", "オプション", "おすすめ",
)
ACTION_TERMS = (
    "choose", "check", "guide", "tips", "buy", "price", "estimate", "book", "apply", "contact", "選ぶ", "確認", "ガイド",
    "ポイント", "購入", "見積", "予約", "問い合わせ",
)
FRESHNESS_TERMS = (
    "updated", "last updated", "reviewed", "valid until", "as of", "2024", "2025", "2026", "2027", "2028", "2029", "更新",
    "掲載日", "改定", "時点", "現在", "有効期限", "copyright", "©",
)
FAQ_TERMS = ("faq", "q&a", "よくある質問", "質問", "お問い合わせ", "ご質問", "question", "answer")
DOCUMENT_TERMS = (
    "terms", "conditions", "privacy", "sitemap", "contact", "warranty", "brochure", "catalogue", "spec", "specification",
    "pdf", "主要装備一覧", "諸元表", "カタログ", "保証", "条件",
)
CTA_TERMS = ("book", "estimate", "contact", "dealer", "buy", "apply", "予約", "見積", "問い合わせ", "販売店")
# Fixed patterns: counted families, leftmost match first.
NOISE_TERMS = r"(cookie|ad blocker|subscribe popup|consent management|utm_|fbclid|gclid)"
CONTENT_TERMS = r"(vehicle|car|ev|charging|battery|range|hybrid|warranty|service|price|cost|review|safety|faq|車|充電|保証|整備|価格|安全)"

_NO_TYPES = "array<string>"


def evidence_signals(
    markdown,
    schema_types: Column | None = None,
    json_ld_present: Column | None = None,
    canonical: Column | None = None,
    description: Column | None = None,
    robots: Column | None = None,
    hreflang_count: Column | None = None,
    pdf_count: Column | None = None,
    dates: Column | None = None,
    header_chars: Column | None = None,
    footer_chars: Column | None = None,
    metrics: Column | None = None,
) -> Column:
    """Struct of 36 signals; page facts that are not given count as absent.

    ``metrics`` are the ``markdown_metrics`` of the text where they are already at hand.
    """
    or_else = lambda c, default: F.coalesce(c, F.lit(default)) if c is not None else F.lit(default)
    empty = F.array().cast(_NO_TYPES)
    types = F.array_distinct(F.coalesce(schema_types, empty)) if schema_types is not None else empty
    dates = F.coalesce(dates, empty) if dates is not None else empty
    header, footer = or_else(header_chars, 0), or_else(footer_chars, 0)
    has_type = lambda *names: F.exists(types, lambda t: F.lower(t).isin(*names))

    def build(row: Column) -> Column:
        text, low, m = row["text"], row["low"], row["metrics"]
        has = lambda terms: any_term(low, terms)
        domain = row["domain"]
        citation, documents = row["citation"], row["documents"]
        noise, content = row["noise"], row["content"]
        ratio = F.bround(noise / F.greatest(F.lit(1), content), 2)
        return F.struct(
            ((text != "") & (m["heading_count"] >= 1) & (domain | (F.length(text) > 400))).alias("answer_first"),
            (m["heading_count"] >= 2).alias("headings_present"),
            ((m["heading_count"] >= 2) & (m["unique_line_count"] >= 15) & (m["markdown_chars"] >= 900)).alias("extractable_passages"),
            (ratio <= 0.4).alias("low_noise_ratio"),
            (has(FAQ_TERMS) | (m["question_count"] >= 2)).alias("faq_like"),
            has(COMPARISON_TERMS).alias("comparison_terms"),
            has(ACTION_TERMS).alias("actionable_terms"),
            domain.alias("domain_specific_terms"),
            (m["numeric_fact_count"] >= 5).alias("key_facts"),
            (m["numeric_fact_count"] >= 5).alias("statistics_or_numbers"),
            citation.alias("source_citations"),
            (m["link_count"] >= 3).alias("internal_links"),
            F.exists(m["links_sample"], lambda u: U.authority(u) != "").alias("external_links"),
            documents.alias("pdf_or_spec_links"),
            or_else(pdf_count, 0).alias("linked_pdf_count"),
            (m["image_count"] >= 3).alias("image_alt_evidence"),
            or_else(json_ld_present, False).alias("schema_json_ld"),
            types.alias("schema_types"),
            has_type("product").alias("product_schema"),
            has_type("faqpage").alias("faq_schema"),
            has_type("offer", "offercatalog").alias("offer_schema"),
            has_type("organization").alias("organization_schema"),
            has_type("breadcrumblist").alias("breadcrumb_schema"),
            (or_else(canonical, "") != "").alias("canonical"),
            (or_else(description, "") != "").alias("meta_description"),
            (~F.contains(F.lower(or_else(robots, "")), F.lit("noindex"))).alias("robots_indexable"),
            or_else(hreflang_count, 0).alias("hreflang_count"),
            ((F.size(dates) > 0) | has(FRESHNESS_TERMS)).alias("freshness_signals"),
            dates.alias("visible_dates"),
            (citation | documents | (footer > 200)).alias("authority_signals"),
            has(CTA_TERMS).alias("cta_links"),
            (footer > 50).alias("footer_present"),
            (header > 50).alias("header_present"),
            noise.alias("nav_noise_terms"),
            content.alias("content_terms"),
            ratio.alias("noise_ratio"),
        )

    def measure(text: Column) -> Column:
        return let(
            F.struct(text.alias("text"), F.lower(text).alias("low"), (markdown_metrics(text) if metrics is None else metrics).alias("metrics")),
            lambda r: F.struct(
                r["text"].alias("text"), r["low"].alias("low"), r["metrics"].alias("metrics"),
                any_term(r["low"], DOMAIN_TERMS).alias("domain"),
                ((r["metrics"]["link_count"] >= 3) | any_term(r["low"], CITATION_TERMS)).alias("citation"),
                ((r["metrics"]["pdf_link_count"] >= 1) | any_term(r["low"], DOCUMENT_TERMS)).alias("documents"),
                count_of(r["low"], NOISE_TERMS).alias("noise"), count_of(r["low"], CONTENT_TERMS).alias("content"),
            ),
        )

    return let(let(compact_block(markdown), measure), build)
