"""Run and job status: fold of patches, active decision, listings, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import text_or_empty
from citegrain.operators import registry
from citegrain.operators.frames import ensure_columns, first_n
from citegrain.operators.registry import (
    FAILED_STATES, IN_PROGRESS_STATES, REPORT_READY_STAGES, SUCCESS_STATES,
)

STALE_SECONDS = 3600
AUDITOR_STALE_SECONDS = 7200


def fold_aggregates(columns, order: str = "ord", epoch: str = "ts"):
    """Aggregates of the status fold: last present value per field and first epochs by outcome."""
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns
    ]
    first_when = lambda states: F.min(F.when(F.lower("status").isin(*states), F.col(epoch)))
    return [
        *last,
        F.max(epoch).alias("updated_at"),
        first_when(SUCCESS_STATES).alias("completed_at"),
        first_when(FAILED_STATES).alias("failed_at"),
        first_when(IN_PROGRESS_STATES).alias("started_at"),
    ]


def fold_status(events: DataFrame, key: str = "run_id", columns=None, order: str = "ord", epoch: str = "ts") -> DataFrame:
    """Latest state per run: every field keeps its last present value.

    ``order`` is a total order of the patches (a struct works). All aggregates combine on the
    map side, so a run with very many events costs one partial row per task.
    """
    skip = {key, order, epoch}
    columns = columns or [c for c in events.columns if c not in skip]
    return events.groupBy(key).agg(*fold_aggregates(columns, order=order, epoch=epoch))


def error_columns(columns) -> list[str]:
    return [c for c in columns if c == "error" or c.endswith("_error")]


def is_active(columns, now: Column, updated: str = "updated_at_epoch",
              stale_seconds: int = STALE_SECONDS, auditor_stale_seconds: int = AUDITOR_STALE_SECONDS) -> Column:
    """Ordered rules: terminal, ready, error, failed stage, failed flag, stale, in progress.

    Every column named ``error`` or ``*_error`` is an error field. ``updated`` and ``now`` are
    epoch seconds; zero or NULL means unknown and never stale.
    """
    status, stage = F.lower(text_or_empty("status")), F.lower(text_or_empty("stage"))
    has_error = F.lit(False)
    for name in error_columns(columns):
        has_error = has_error | (text_or_empty(name) != "")
    flagged = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in columns else F.lit(False)
    known = [F.nullif(F.col(c), F.lit(0)) for c in (updated, "started_at_epoch", "created_at_epoch") if c in columns]
    seen = F.coalesce(*known, F.lit(0))
    limit = F.when(stage.startswith("auditor") | (stage == "evidence_ready"), auditor_stale_seconds).otherwise(stale_seconds)
    return (
        F.when(status.isin(*SUCCESS_STATES, *FAILED_STATES), False)
        .when(stage.isin(*REPORT_READY_STAGES), False)
        .when(has_error, False)
        .when(stage.endswith("_failed"), False)
        .when(flagged, False)
        .when((seen > 0) & (now - seen > limit), False)
        .when(status.isin(*IN_PROGRESS_STATES), True)
        .when(stage == "evidence_ready", True)
        .otherwise(False)
    )


def listing(states: DataFrame, limit: int = 20) -> DataFrame:
    """Runs newest first (by update, else by creation time), the first ``limit``."""
    states = ensure_columns(states, created_at_epoch="bigint")
    recent = F.coalesce(F.nullif("updated_at_epoch", F.lit(0)), F.nullif("created_at_epoch", F.lit(0)), F.lit(0))
    return states.orderBy(F.desc(recent), F.desc("run_id")).limit(max(1, limit))


def requested(requests: DataFrame, states: DataFrame, manifests: DataFrame, limit: int = 20) -> DataFrame:
    """Status answers to requests (request_id, brand, market, domain): one row each.

    ``runs`` are the matching runs newest first, the first ``limit`` of them (1 to 100), ``active_run_id`` the newest
    active one of all that match, ``latest_successful_run_id`` the newest report-ready run. A blank filter fits every
    run, and a run without domain fits every domain. ``states``: run_id, brand, market, domain, updated_at_epoch,
    created_at_epoch, active. Each state counts for eight kinds of request, whose lists are cut before any request is
    joined, so that requests never meet all runs.
    """
    keyed = ensure_columns(states, created_at_epoch="bigint", brand="string", market="string", domain="string")
    recent = F.coalesce(F.nullif("updated_at_epoch", F.lit(0)), F.nullif("created_at_epoch", F.lit(0)), F.lit(0))
    either = lambda c, name: F.explode(F.array(F.lit(None).cast("string"), U.registry_key(c))).alias(name)
    rows = keyed.select("run_id", "active", recent.alias("recent"), "market", "domain", either("brand", "b"))
    rows = rows.select("run_id", "active", "recent", "b", "domain", either("market", "m")).select("run_id", "active", "recent", "b", "m", either("domain", "d"))
    newest = [F.desc("recent"), F.desc("run_id")]
    lists = first_n(rows, ["b", "m", "d"], newest, max(1, min(limit, 100)))
    active = rows.where("active").groupBy("b", "m", "d").agg(F.max(F.struct("recent", "run_id")).alias("active"))

    open_or = lambda c: F.when(text_or_empty(c) != "", U.registry_key(c))
    asked = requests.select("request_id", open_or("brand").alias("rb"), open_or("market").alias("rm"), open_or("domain").alias("rd"))
    own = F.explode(F.when(F.col("rd").isNull(), F.array(F.col("rd"))).otherwise(F.array_distinct(F.array("rd", F.lit(""))))).alias("rd")
    asked = asked.select("request_id", "rb", "rm", own)
    meet = F.col("rb").eqNullSafe(F.col("b")) & F.col("rm").eqNullSafe(F.col("m")) & F.col("rd").eqNullSafe(F.col("d"))
    top = first_n(asked.join(lists.drop("rank"), meet).select("request_id", "recent", "run_id"), "request_id", newest, max(1, min(limit, 100)))
    # at most a hundred runs a request
    runs = top.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "run_id"))).alias("runs"))
    best = asked.join(active, meet).groupBy("request_id").agg(F.max("active")["run_id"].alias("active_run_id"))
    found = registry.scan_for_requests(requests, manifests).withColumnRenamed("run_id", "latest_successful_run_id")
    out = requests.select("request_id").join(runs, "request_id", "left").join(best, "request_id", "left").join(found, "request_id", "left")
    ids = F.coalesce(F.transform("runs", lambda r: r["run_id"]), F.array().cast("array<string>"))
    return out.select("request_id", "latest_successful_run_id", "active_run_id", ids.alias("runs"))


def first_active(states: DataFrame, keys=()) -> DataFrame:
    """The most recently updated active run per key."""
    active = states.where("active")
    order = F.struct("updated_at_epoch", "run_id")
    return active.groupBy(*keys).agg(F.max_by("run_id", order).alias("active_run_id"))


def episodes(events: DataFrame, gap: str = "1 hour", key: str = "run_id", ts: str = "ts") -> DataFrame:
    """Activity episodes: a silence of ``gap`` or more ends one. Works on batch and streams."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(
        key, F.col("w.start").alias("episode_start"), F.col("w.end").alias("episode_end"), "events"
    )


def latest_by_job(events: DataFrame) -> DataFrame:
    """Job progress: the same fold on ``job_id``."""
    return fold_status(events, key="job_id")
