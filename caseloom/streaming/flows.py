"""Structured Streaming flows. History lives in tables; every batch writes its own partition.

A batch that is run again after a failure overwrites its partition, so results stay exact; no stream keeps
unbounded state.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from caseloom.functions.text import strip
from caseloom.operators.documents import IN_FLIGHT_STATES, TERMINAL_STATES, intake_decisions, running_usage
from caseloom.operators.text_index import TextIndex
from caseloom.operators.textprep import preflight, route, source_kind

LOG_LIMIT, LOG_LIMIT_MAX = 500, 2000


def _put_batch(df: DataFrame, path: str, batch_id: int, *parts: str) -> None:
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *parts).parquet(path)


def _earlier_batches(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of the batches before this one; empty where nothing has been written yet, any other fault is raised."""
    try:
        return spark.read.parquet(path).filter(F.col("batch_id") < batch_id)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _prefix(c: str) -> Column:
    # a letter in front, so that a folder name is never read as a number
    return F.concat(F.lit("h"), F.substring(c, 1, 2))


def _start(stream: DataFrame, each_batch, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def intake(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """New documents: hash check, duplicates per case against everything stored, preflight and route; accepted rows are appended.

    stream(case_id, document_id, file_name, mime_type, profile, content, claimed_hash, allow_duplicate, created_ord).
    """
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("content_hash", F.sha2("content", 256)).persist()
        stored = _earlier_batches(batch.sparkSession, path, batch_id, "case_id string, content_hash string, batch_id int, prefix string")
        # hashes are kept by their first two digits: only those of this batch are read, and only its own hashes meet
        prefixes = [r[0] for r in batch.select(_prefix("content_hash")).distinct().collect()]
        stored = stored.filter(F.col("prefix").isin(prefixes)).join(batch.select("content_hash").distinct(), "content_hash", "left_semi")
        accepted = intake_decisions(batch, stored).filter("decision = 'accepted'").select("case_id", "document_id")
        fresh = batch.join(accepted, ["case_id", "document_id"], "left_semi")
        chosen = route(source_kind(F.col("file_name"), F.col("mime_type")), F.col("profile"), F.lit(""), F.lit("")).alias("route")
        routed = fresh.select("case_id", "document_id", "content_hash", "created_ord", chosen).select("case_id", "document_id", "content_hash", "created_ord", "route.*")
        facts = preflight(fresh).select("case_id", "document_id", "source_kind", "size_bytes", "complexity_class", "eta_seconds")
        done = routed.join(facts, ["case_id", "document_id"]).withColumns({"status": F.lit("queued"), "prefix": _prefix("content_hash")})
        _put_batch(done, path, batch_id, "prefix")
        batch.unpersist()

    return _start(stream, each_batch, checkpoint, available_now=available_now)


def log_level(c: Column) -> Column:
    level = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(level == "", "info").when(level == "warn", "warning").otherwise(level)


def tidy_logs(logs: DataFrame) -> DataFrame:
    return logs.withColumn("level", log_level(F.col("level"))).withColumn("message", strip(F.col("message"))).filter("message <> ''")


def log_tail(logs: DataFrame, after_id: int = 0, limit: int = LOG_LIMIT) -> DataFrame:
    """Log rows after the cursor in id order."""
    return tidy_logs(logs).filter(F.col("id") > max(0, after_id)).orderBy("id").limit(max(1, min(limit, LOG_LIMIT_MAX)))


def follow_logs(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Continuous form of the tail: the stream's own offsets are the cursor."""
    return _start(stream, lambda batch, n: _put_batch(tidy_logs(batch), path, n), checkpoint, available_now=available_now)


def track_jobs(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Status reports (job_id, status, seq): every batch stores the newest status of its jobs."""
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
        _put_batch(latest, path, batch_id)

    return _start(stream, each_batch, checkpoint, available_now=available_now)


def job_states(reports: DataFrame) -> DataFrame:
    """Newest status per job and whether it is final."""
    latest = reports.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    return latest.withColumn("terminal", F.col("status").isin(TERMINAL_STATES))


def after_restart(states: DataFrame) -> DataFrame:
    """Jobs caught in the middle of work by a restart have failed."""
    caught = F.col("status").isin(IN_FLIGHT_STATES)
    return states.withColumn("status", F.when(caught, "failed").otherwise(F.col("status"))).withColumn("terminal", F.col("status").isin(TERMINAL_STATES))


def index_new_segments(stream: DataFrame, index: TextIndex, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Segments that are not indexed yet; one that arrives again, in a batch or later, is passed over.

    A batch reads the shards of its own documents only. One that is run again after a failure is known by its tag.
    """
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        TextIndex(batch.sparkSession, index.path, index.buckets, index.shards, index.parts).apply(batch, replace=False, tag=f"{checkpoint}#{batch_id}")

    return _start(stream, each_batch, checkpoint, available_now=available_now)


def live_usage(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Running usage per stage and model; each batch writes a version of its own, so a reader never meets a half-written table."""
    return _start(running_usage(stream), lambda batch, n: _put_batch(batch.coalesce(1), path, n), checkpoint, mode="complete", available_now=available_now)


def latest_usage(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of the usage table."""
    versions = spark.read.parquet(path)
    return versions.filter(F.col("batch_id") == versions.agg(F.max("batch_id")).scalar()).drop("batch_id")
