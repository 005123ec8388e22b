"""Streams whose state is bounded by event time: windowed usage, intake with a look-back, and jobs with timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from caseloom.operators.documents import IN_FLIGHT_STATES, TERMINAL_STATES
from caseloom.streaming.flows import _put_batch, _start

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB = "job_id long, status string, seq long, terminal boolean"


def usage_windows(stream: DataFrame, path: str, checkpoint: str, window: str = "1 day", late: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """Usage per stage, model and window of time; a window is written once, when the stream is `late` past its end.

    stream(called_at, stage, model, latency_ms, total_tokens, error). Latencies are kept as a quantile sketch, so windows can be
    put together. Only open windows are state; calls that come after their window was written are dropped.
    """
    grouped = stream.withWatermark("called_at", late).groupBy(F.window("called_at", window), "stage", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("total_tokens").alias("total_tokens"),
        F.max("latency_ms").alias("max_latency_ms"), F.kll_sketch_agg_double("latency_ms").alias("sketch"))
    rows = grouped.select(F.col("window.start").alias("from_time"), F.col("window.end").alias("to_time"), "stage", "model", "calls", "errors", "total_tokens", "max_latency_ms", "sketch")
    return _start(rows, lambda batch, n: _put_batch(batch, path, n), checkpoint, available_now=available_now)


def usage_over(windows: DataFrame, *keys: str) -> DataFrame:
    """Windows put together per keys; quantiles come from the merged sketches."""
    merged = windows.groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("total_tokens").alias("total_tokens"),
        F.max("max_latency_ms").alias("max_latency_ms"), F.kll_merge_agg_double("sketch").alias("sketch"))
    quantile = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return merged.withColumns({"p50_latency_ms": quantile(0.5), "p95_latency_ms": quantile(0.95)}).drop("sketch")


def intake_within(stream: DataFrame, path: str, checkpoint: str, look_back: str = "30 days", available_now: bool = True) -> StreamingQuery:
    """Accepts the first document of each hash and case; a repetition is known for as long as `look_back` after it in event time.

    stream(case_id, document_id, content, arrived_at). State is one hash per document of the look-back, whatever was stored before;
    flows.intake() compares with everything stored instead. Documents older than the look-back are dropped as late.
    """
    hashed = stream.select("case_id", "document_id", F.sha2("content", 256).alias("content_hash"), "arrived_at")
    fresh = hashed.withWatermark("arrived_at", look_back).dropDuplicatesWithinWatermark(["case_id", "content_hash"])
    return _start(fresh, lambda batch, n: _put_batch(batch, path, n), checkpoint, available_now=available_now)


class JobTracker(StatefulProcessor):
    """Newest status of one job; timers in event time fail it when it stalls and forget it some time after its end."""

    def __init__(self, stall_ms: int, keep_ms: int):
        self.stall_ms, self.keep_ms = stall_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "status string, seq long, due long")

    def _store(self, status: str, seq: int, at: int, before: int) -> None:
        if before:
            self.handle.deleteTimer(before)
        due = at + self.stall_ms if status in IN_FLIGHT_STATES else at + self.keep_ms if status in TERMINAL_STATES else 0
        if due:
            self.handle.registerTimer(due)
        self.latest.update((status, seq, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: r.seq)
        known = self.latest.get() if self.latest.exists() else None
        if known is None or newest.seq > known[1]:
            self._store(newest.status, newest.seq, newest.at, known[2] if known else 0)
            yield Row(job_id=key[0], status=newest.status, seq=newest.seq, terminal=newest.status in TERMINAL_STATES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        known = self.latest.get() if self.latest.exists() else None
        if known is None or known[2] != at:
            return
        if known[0] in TERMINAL_STATES:
            self.latest.clear()
            return
        self._store("failed", known[1], at, 0)
        yield Row(job_id=key[0], status="failed", seq=known[1], terminal=True)

    def close(self) -> None:
        pass


def track_jobs_with_timers(
    stream: DataFrame, path: str, checkpoint: str, stall: str = "6 hours", keep: str = "7 days", late: str = "1 hour", available_now: bool = True,
) -> StreamingQuery:
    """Status reports (job_id, status, seq, reported_at): every change of a job is written, also that it failed by stalling.

    A job that is in work and silent for `stall` in event time has failed. The state of a finished job is dropped `keep` after
    its end, so state grows with the jobs of that time only; a later report of it counts as a new job's.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    length = lambda text: int(spark.sql(f"select unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {text})").first()[0])
    reports = stream.withWatermark("reported_at", late).select("job_id", "status", "seq", "reported_at", F.unix_millis("reported_at").alias("at"))
    changes = reports.groupBy("job_id").transformWithState(JobTracker(length(stall), length(keep)), JOB, "Update", "EventTime")
    return _start(changes, lambda batch, n: _put_batch(batch, path, n), checkpoint, mode="update", available_now=available_now)


def tracked_jobs(changes: DataFrame) -> DataFrame:
    """Newest written change per job; of one report, the failure by stalling comes last."""
    return changes.groupBy("job_id").agg(F.max_by(F.struct("status", "seq", "terminal"), F.struct("seq", "batch_id")).alias("s")).select("job_id", "s.*")
