"""Status and progress as streams: state fold, active runs with expiry, counters, episodes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from citegrain.functions.text import text_or_empty
from citegrain.operators import status as S
from citegrain.operators.registry import FAILED_STATES, IN_PROGRESS_STATES, REPORT_READY_STAGES, SUCCESS_STATES

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counters_stream(pages: DataFrame, *keys) -> DataFrame:
    """Collected, weak and failed pages so far, per key (``update`` or ``complete`` mode)."""
    state = text_or_empty("crawl_status")
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages_requested"),
        F.count_if(state == "success").alias("pages_collected"),
        F.count_if(state.isin("weak", "partial")).alias("pages_weak"),
        F.count_if(state.isin("failed", "blocked", "error")).alias("pages_failed"),
    )


def episodes_stream(events: DataFrame, gap: str = "1 hour", delay: str = "10 minutes", key: str = "run_id", ts: str = "ts") -> DataFrame:
    """Activity episodes emitted once the watermark passes their end (``append`` mode)."""
    return S.episodes(events.withWatermark(ts, delay), gap, key, ts)


# A run leaves the state so long after its last patch, whatever became of it.
KEEP_SECONDS = 7 * 86400
# Epochs of the first patch of an outcome, by the states that mean it.
OUTCOMES = {"completed_at": SUCCESS_STATES, "failed_at": FAILED_STATES, "started_at": IN_PROGRESS_STATES}


def _combined(columns: tuple[str, ...]):
    """Map-side combine: per run and Arrow batch one patch, the last present value of each column with its place."""

    def combine(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            if batch.empty:
                continue
            b = batch.sort_values(["us", "event_id"], kind="stable")
            runs = b.groupby("run_id", sort=False, dropna=False)
            out = pd.DataFrame({"ts": runs["ts"].max(), "updated": runs["us"].max()})
            for c in columns:
                last = b[b[c].notna()].groupby("run_id", sort=False, dropna=False)[[c, "us", "event_id"]].last()
                out = out.join(last.rename(columns={"us": f"{c}_us", "event_id": f"{c}_id"}))
            state = b["status"].str.lower()
            for name, states in OUTCOMES.items():
                out[name] = b["us"].where(state.isin(states)).groupby(b["run_id"], sort=False, dropna=False).min()
            numbers = [c for c in out.columns if c.endswith(("_us", "_id", "_at"))]
            out[numbers] = out[numbers].astype("Int64")
            yield out.reset_index()

    places = ", ".join(f"{c} string, {c}_us bigint, {c}_id bigint" for c in columns)
    return combine, f"run_id string, ts timestamp, updated bigint, {places}, {', '.join(f'{n} bigint' for n in OUTCOMES)}"


def _decide(status: str, stage: str, failed: bool) -> tuple[bool, str]:
    if status in SUCCESS_STATES or status in FAILED_STATES:
        return False, "terminal"
    if stage in REPORT_READY_STAGES:
        return False, "report_ready"
    if failed or stage.endswith("_failed"):
        return False, "failed"
    if status in IN_PROGRESS_STATES or stage == "evidence_ready":
        return True, "in_progress"
    return False, "unknown"


class RunStates(StatefulProcessor):
    """Fold and activity of a run in one state value, with one event-time timer: stale first, then out of the state."""

    def __init__(self, columns: tuple[str, ...], keep_seconds: int):
        self.columns, self.keep_ms = columns, keep_seconds * 1000
        self.names = ["updated", *[f"{c}{part}" for c in columns for part in ("", "_us", "_id")], *OUTCOMES, "alarm", "running"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = lambda n: "string" if n in self.columns else "boolean" if n == "running" else "bigint"
        self.handle = handle
        self.state = handle.getValueState("run", ", ".join(f"{n} {kind(n)}" for n in self.names))

    def _row(self, key: tuple, held: dict, active: bool, reason: str) -> Row:
        moment = lambda us: None if us is None else datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)
        times = {"updated_at": moment(held["updated"])} | {n: moment(held[n]) for n in OUTCOMES}
        return Row(run_id=key[0], **{c: held[c] for c in self.columns}, **times, active=active, reason=reason)

    def _keep(self, held: dict, alarm: int, now: int) -> None:
        if held["alarm"] is not None:
            self.handle.deleteTimer(held["alarm"])
        held["alarm"] = max(alarm, now + 1)
        self.handle.registerTimer(held["alarm"])
        self.state.update(tuple(held[n] for n in self.names))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = dict(zip(self.names, self.state.get())) if self.state.exists() else dict.fromkeys(self.names)
        for patch in rows:
            held["updated"] = max(held["updated"] or 0, patch["updated"])
            for c in self.columns:
                place = patch[f"{c}_us"], patch[f"{c}_id"]
                if place[0] is not None and (held[f"{c}_us"] is None or place >= (held[f"{c}_us"], held[f"{c}_id"])):
                    held[c], held[f"{c}_us"], held[f"{c}_id"] = patch[c], *place
            for n in OUTCOMES:
                held[n] = min((x for x in (held[n], patch[n]) if x is not None), default=None)
        text = lambda c: held[c].lower() if c in self.columns and held[c] else ""
        stage = text("stage")
        active, reason = _decide(text("status"), stage, any(held[c] for c in S.error_columns(self.columns)))
        seconds = S.AUDITOR_STALE_SECONDS if stage.startswith("auditor") or stage == "evidence_ready" else S.STALE_SECONDS
        updated = held["updated"] // 1000
        deadline = updated + seconds * 1000
        held["running"] = active and deadline > now
        self._keep(held, deadline if held["running"] else updated + self.keep_ms, now)
        yield self._row(key, held, held["running"], "stale" if active and not held["running"] else reason)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = dict(zip(self.names, self.state.get())) if self.state.exists() else None
        if held is None or held["alarm"] != expiredTimerInfo.getExpiryTimeInMs():
            return
        if not held["running"]:
            self.state.clear()
            return
        held["running"], held["alarm"] = False, None  # the timer that rang is gone
        removal, now = held["updated"] // 1000 + self.keep_ms, timerValues.getCurrentWatermarkInMs()
        if removal <= now:
            self.state.clear()
        else:
            self._keep(held, removal, now)
        yield self._row(key, held, False, "stale")

    def close(self) -> None:
        pass


def run_states(events: DataFrame, columns=("status", "stage", "error"), delay: str = "10 minutes", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """A row whenever a run changes or goes stale: its fold, first epochs, and whether it is active and why.

    ``events``: run_id, ts, ``columns`` (status among them) and perhaps event_id, which decides among equal times. NULLs
    keep the earlier value, an empty error clears it; every column named ``error`` or ``*_error`` is an error field. A
    run is stale an hour after its last patch, two in auditor stages, and leaves the state after ``keep_seconds``, so
    the state holds the runs of that time only; a later patch begins anew. Patches later than ``delay`` are not taken.
    Patches are combined before the shuffle.
    """
    columns = tuple(columns)
    place = F.col("event_id").cast("bigint") if "event_id" in events.columns else F.lit(0).cast("bigint")
    rows = events.select("run_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), place.alias("event_id"),
                         *[F.col(c).cast("string").alias(c) for c in columns])
    combine, schema = _combined(columns)
    times = ", ".join(f"{n} timestamp" for n in ("updated_at", *OUTCOMES))
    out = f"run_id string, {', '.join(f'{c} string' for c in columns)}, {times}, active boolean, reason string"
    keyed = rows.mapInPandas(combine, schema).withWatermark("ts", delay).groupBy("run_id")
    return keyed.transformWithState(RunStates(columns, keep_seconds), out, "Update", "EventTime")


def status_stream(events: DataFrame, columns, delay: str = "10 minutes", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """Latest state per run, updated as events arrive; events within ``delay`` fold correctly in any order (``update`` mode)."""
    return run_states(events, columns, delay, keep_seconds).drop("active", "reason")


def active_runs_stream(events: DataFrame, delay: str = "10 minutes", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """A row whenever a run changes: active or not and why, and one when it goes stale (``update`` mode)."""
    return run_states(events, ("status", "stage", "error"), delay, keep_seconds).select("run_id", "active", "reason", "updated_at")


def start(stream: DataFrame, sink, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run a stream to the end of the available input; ``sink(df, batch_id)`` must be idempotent. State is kept in RocksDB."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_PROVIDER, None)
    conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return writer.foreachBatch(sink).start()
    finally:
        conf.unset(STATE_PROVIDER) if before is None else conf.set(STATE_PROVIDER, before)
