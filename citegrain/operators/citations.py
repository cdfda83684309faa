"""AI answers and their citations: normalisation, sources, per-query statistics, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import clean_value, text_or_empty
from citegrain.operators.classify import citation_visibility, cited_source_type
from citegrain.operators.frames import ensure_columns, first_n, first_wins
from citegrain.operators.page_features import _first_by_key

# Status words and texts of collected answers.
WITH_CITATIONS = "serpapi_completed_with_citations"
NO_CITATIONS = "serpapi_completed_no_citations"
PENDING_SUMMARY = "SerpAPI collection pending."
SUMMARY_WITHOUT = "SerpAPI completed but no AI answer summary was returned."
SUMMARY_WITH = "SerpAPI completed; citation references were returned."
DEFAULT_TYPE = "external_citation"
TOP = 3

# Alias fields a raw reference may carry; ``from_json`` fills what is there.
RAW_REFERENCE = (
    "struct<rank:bigint,title:string,url:string,source_url:string,link:string,source_domain:string,"
    "source_name:string,source:string,snippet:string,description:string,text:string,source_type:string>"
)


def _pick(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def clean_references(references: Column, entities: bool = False) -> Column:
    """Valid distinct references with defaults; rank falls back to the original position."""
    with_rank = F.transform(references, lambda r, i: F.struct(
        F.coalesce(F.nullif(r["rank"], F.lit(0)), (i + 1).cast("bigint")).alias("rank"),
        _pick(r["url"], r["source_url"], r["link"]).alias("url"), r.alias("raw"),
    ))
    valid = F.filter(with_rank, lambda r: F.coalesce(r["url"], F.lit("")).rlike("^https?://"))
    unique = _first_by_key(valid, lambda r: r["url"])
    text = lambda c: clean_value(c, entities=entities)

    def shape(r: Column) -> Column:
        raw, host = r["raw"], U.host(r["url"])
        return F.struct(
            r["rank"].alias("rank"),
            text(_pick(raw["title"], raw["source_name"], host)).alias("title"),
            r["url"].alias("url"),
            _pick(raw["source_domain"], host).alias("source_domain"),
            text(_pick(raw["source_name"], raw["source"], host)).alias("source_name"),
            text(_pick(raw["snippet"], raw["description"], raw["text"])).alias("snippet"),
            F.coalesce(_pick(raw["source_type"]), cited_source_type(r["url"])).alias("source_type"),
        )

    return F.transform(unique, shape)


def normalise_answers(answers: DataFrame, entities: bool = True) -> DataFrame:
    """Answer rows with clean references, counts, repaired summary and status.

    ``references`` is ``array<RAW_REFERENCE>``; ``summary``/``answer``/``status`` are optional.
    """
    a = ensure_columns(
        answers, answer_summary="string", summary="string", answer="string", status="string",
        reconstructed_markdown="string",
    )
    a = a.withColumn("references", clean_references(F.coalesce("references", F.array().cast(f"array<{RAW_REFERENCE}>"))))
    count = F.size("references")
    given = clean_value(_pick(F.col("answer_summary"), F.col("summary"), F.col("answer")), entities=entities)
    return a.withColumns({
        "answer_summary": F.when(
            (given == "") | (given == PENDING_SUMMARY), F.when(count > 0, SUMMARY_WITH).otherwise(SUMMARY_WITHOUT)
        ).otherwise(given),
        "reconstructed_markdown": clean_value("reconstructed_markdown", entities=entities),
        "top_citations": F.slice("references", 1, TOP),
        "citation_count": count.cast("bigint"),
        "status": F.when(
            (text_or_empty("status") == "") | F.col("status").startswith("pending"),
            F.when(count > 0, WITH_CITATIONS).otherwise(NO_CITATIONS),
        ).otherwise(F.col("status")),
    })


def explode_citations(answers: DataFrame, references: str = "references") -> DataFrame:
    """One row per reference with its position; references of one answer are few (≤ 10)."""
    keys = [c for c in ("run_id", "query_id", "query") if c in answers.columns]
    # the outer form keeps Spark from testing the size first, which would clean every list twice
    rows = answers.select(*keys, F.posexplode_outer(references).alias("pos", "r")).where("pos IS NOT NULL")
    return rows.select(*keys, "pos", "r.*").withColumn("citation_position", citation_rank())


def citation_rank(rank: str = "rank", position: str | None = None, pos: str = "pos") -> Column:
    """rank → citation_position → place in the list."""
    parts = [F.col(rank).cast("bigint")] + ([F.col(position).cast("bigint")] if position else [])
    return F.coalesce(*parts, (F.col(pos) + 1).cast("bigint"))


def sources(citations: DataFrame, keys=("run_id",), order=("pos",), attributes=("source_type",)) -> DataFrame:
    """One row per cited URL: citation count and the first-seen attributes."""
    return citations.groupBy(*keys, "url").agg(
        F.count("*").alias("citation_count"),
        F.min_by(F.struct(*attributes), F.struct(*order)).alias("_first"),
    ).select(*keys, "url", "citation_count", *[F.col(f"_first.{a}").alias(a) for a in attributes])


def source_queries(citations: DataFrame, keys=("run_id",)) -> DataFrame:
    """Which queries cite a URL and how often: rows, because a popular source has no bounded list."""
    return citations.groupBy(*keys, "url", "query_id").agg(F.count("*").alias("citations"))


def source_type_counts(source_rows: DataFrame, *keys) -> DataFrame:
    kind = F.coalesce(F.nullif("source_type", F.lit("")), F.lit(DEFAULT_TYPE)).alias("source_type")
    return source_rows.groupBy(*keys, kind).agg(F.count("*").alias("sources"))


def per_query(citations: DataFrame, keys=("run_id", "query_id"), order=("citation_position",)) -> DataFrame:
    """Citation count, leading domain and sorted distinct source types of each query.

    The ordered citations and domains of a query stay rows (``top_citations``).
    """
    kind = F.coalesce(F.nullif("source_type", F.lit("")), F.lit(DEFAULT_TYPE))
    domain = F.nullif("source_domain", F.lit(""))
    return citations.groupBy(*keys).agg(
        F.count("*").alias("citation_count"),
        F.min_by(domain, F.when(domain.isNotNull(), F.struct(*order))).alias("leading_citation_domain"),
        F.array_sort(F.collect_set(kind)).alias("winning_source_types"),
    )


def top_citations(citations: DataFrame, keys=("run_id", "query_id"), order=("citation_position",), n: int = TOP) -> DataFrame:
    return first_n(citations, keys, list(order), n)


def visibility(queries: DataFrame, citations: DataFrame, keys=("run_id", "query_id"), order=("citation_position",)) -> DataFrame:
    """Queries with their citation statistics and visibility status; uncited queries stay."""
    joined = queries.join(per_query(citations, keys, order), list(keys), "left")
    return joined.withColumns({
        "citation_count": F.coalesce("citation_count", F.lit(0)),
        "winning_source_types": F.coalesce("winning_source_types", F.array().cast("array<string>")),
        "visibility_status": citation_visibility(F.coalesce("citation_count", F.lit(0))),
    })


def distinct_citations(citations: DataFrame, order=("source_rank", "pos"), scope=()) -> DataFrame:
    """Citations distinct by query, comparison URL and position, first occurrence kept."""
    keyed = citations.withColumns({
        "_q": text_or_empty(F.col("query_id").cast("string")), "_u": U.url_key("url"),
        "_p": text_or_empty(F.col("citation_position").cast("string")),
    })
    return first_wins(keyed, [*scope, "_q", "_u", "_p"], list(order)).drop("_q", "_u", "_p")


def citation_hints(candidates: DataFrame, columns, keys=("run_id",), order: str = "ord") -> DataFrame:
    """Per cited URL the last present value of each hint column (later sources win)."""
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns
    ]
    return candidates.where(text_or_empty("url") != "").groupBy(*keys, "url").agg(*last)


def reusable_answers(answers: DataFrame, portfolio: DataFrame, run: str = "run_id", entities: bool = True) -> DataFrame:
    """Earlier answers whose query id or cleaned text is asked again; all when nothing is asked.

    Id matches and text matches are disjoint branches, so no de-duplication is needed.
    """
    text = lambda c: F.lower(clean_value(c, entities=entities))
    asked_ids = portfolio.select(run, F.trim(F.col("query_id").cast("string")).alias("_id")).where("_id != ''").distinct()
    asked_texts = portfolio.select(run, text("query").alias("_text")).where("_text != ''").distinct()
    rows = answers.withColumns({"_id": F.trim(F.col("query_id").cast("string")), "_text": text("query")})
    by_id = rows.join(asked_ids, [run, "_id"], "left_semi")
    by_text = rows.join(asked_ids, [run, "_id"], "left_anti").join(asked_texts, [run, "_text"], "left_semi")
    # a portfolio of blanks asks for nothing
    asking = asked_ids.select(run).unionByName(asked_texts.select(run)).distinct()
    unasked = rows.join(asking, run, "left_anti")
    names = rows.columns
    return by_id.select(names).unionByName(by_text.select(names)).unionByName(unasked.select(names)).drop("_id", "_text")


def answer_totals(answers: DataFrame, *keys) -> DataFrame:
    return answers.groupBy(*keys).agg(
        F.count("*").alias("captured_queries"),
        F.count_if(F.col("citation_count") > 0).alias("queries_with_citations"),
        F.sum("citation_count").alias("total_citations"),
    )


def most_common(rows: DataFrame, value: str, keys=(), order: str = "pos") -> DataFrame:
    """Most frequent present value per key; ties go to the one seen first."""
    present = rows.where(F.col(value).isNotNull() & (F.col(value) != ""))
    counted = present.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(
        F.min_by(value, F.struct((-F.col("n")).alias("neg"), "_first")).alias(value), F.max("n").alias("n")
    )


def query_type_mix(queries: DataFrame, *keys) -> DataFrame:
    return queries.groupBy(*keys, F.coalesce("query_type", F.lit("not_validated")).alias("query_type")).agg(
        F.count("*").alias("queries")
    )
