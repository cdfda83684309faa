"""Streams over several micro-batches give what the batch operators give."""

from pyspark.sql import functions as F

from citegrain.operators import status as S
from citegrain.streaming import status as X

EVENTS = [  # run, second, event id, status, stage, error
    [("a", 0, 1, "accepted", "initialising", None), ("b", 10, 2, "running", "crawl", None)],
    [("a", 600, 3, "running", "auditor_running", None), ("a", 30, 4, "running", None, None), ("c", 700, 5, "failed", None, "boom")],
    [("b", 20000, 6, "completed", "report_bundle_ready", None), ("a", 300, 7, "queued", "late_stage", None)],
    [("d", 40000, 8, "running", "crawl", None)],
    [("e", 60000, 9, "completed", None, None)],
]
SCHEMA = "run_id string, ts timestamp, event_id long, status string, stage string, error string"


def source(spark, path):
    raw = "run_id string, s long, event_id long, status string, stage string, error string"
    for i, rows in enumerate(EVENTS):
        batch = spark.createDataFrame(rows, raw).withColumn("ts", F.timestamp_seconds(F.col("s") + 86400)).select("run_id", "ts", "event_id", "status", "stage", "error")
        batch.coalesce(1).write.mode("append").parquet(str(path / f"in/{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path / "in"))


def run(stream, path, mode):
    seen = []
    sink = lambda df, batch: seen.extend((batch, r) for r in df.collect())
    X.start(stream, sink, str(path / "ck"), mode).awaitTermination()
    return seen


def test_fold_equals_batch(spark, tmp_path):
    rows = run(X.status_stream(source(spark, tmp_path), ("status", "stage", "error"), "1 day"), tmp_path, "update")
    latest = {}
    for _, r in rows:
        latest[r.run_id] = r
    batch = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withColumn("ord", F.struct("ts", "event_id"))
    folded = {r.run_id: r for r in S.fold_status(batch, columns=("status", "stage", "error")).collect()}
    assert {k: tuple(v) for k, v in latest.items()} == {k: tuple(v) for k, v in folded.items()}
    assert (folded["a"].status, folded["a"].stage) == ("running", "auditor_running")  # the late event changes nothing
    assert len(rows) > len(latest)  # several updates were emitted


def test_active_runs_expire(spark, tmp_path):
    rows = run(X.active_runs_stream(source(spark, tmp_path), "1 minute"), tmp_path, "update")
    history = {}
    for _, r in rows:
        history.setdefault(r.run_id, []).append((r.active, r.reason))
    assert history["a"][0] == (True, "in_progress") and history["a"][-1] == (False, "stale")
    assert history["b"][-1] == (False, "terminal") and history["c"] == [(False, "terminal")]
    assert history["d"] == [(True, "in_progress"), (False, "stale")]
    assert history["e"] == [(False, "terminal")]


def test_state_falls_after_the_stated_age(spark, tmp_path):
    """Runs leave the state an hour after their last patch; only those of the last hour are held at the end."""
    held = []
    for keep in (3600 * 1000, 3600):
        folder = tmp_path / str(keep)
        folder.mkdir()
        run(X.active_runs_stream(source(spark, folder), "1 minute", keep), folder, "update")
        state = spark.read.format("statestore").option("stateVarName", "run").load(str(folder / "ck"))
        held.append({r.k for r in state.select(F.col("key.run_id").alias("k")).collect()})
    assert held == [{"a", "b", "c", "d", "e"}, {"e"}]


def test_counters_and_episodes(spark, tmp_path):
    pages = source(spark, tmp_path).select("run_id", F.lit("owned").alias("kind"), F.when(F.col("status") == "completed", "success").otherwise("failed").alias("crawl_status"))
    rows = run(X.counters_stream(pages, "kind"), tmp_path, "complete")
    last = [r for b, r in rows if b == max(b for b, _ in rows)][0]
    assert (last.pages_requested, last.pages_collected, last.pages_failed) == (9, 2, 7)

    (tmp_path / "second").mkdir()
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    closed = run(X.episodes_stream(events, "1 hour", "1 minute"), tmp_path / "second", "append")
    batch = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    expected = {tuple(r) for r in S.episodes(batch, "1 hour").collect()}
    assert closed and {tuple(r) for _, r in closed} <= expected
