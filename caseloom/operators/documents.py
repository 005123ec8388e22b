"""Documents, jobs, cases and chats: duplicates, listings, counters, queues, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import clip, squeeze, strip
from caseloom.session import number_rows, top_per_key

# States, priorities and limits.
ACTIVE_STATES = ["queued", "parsing", "inserting", "indexing"]
IN_FLIGHT_STATES = ["parsing", "inserting", "indexing"]
COMPLETE_STATES = ["complete", "completed_with_warnings"]
TERMINAL_STATES = ["complete", "completed_with_warnings", "failed"]
HISTORY_LENGTH = 24
SNIPPET_LIMIT = 220
UNKNOWNS_LIMIT = 20
SUMMARY_TEXTS = ["intelligence_summary", "investigation_summary", "summary_text"]


def duplicate_matches(probes: DataFrame, documents: DataFrame) -> DataFrame:
    """Every stored document with the hash of a probe (case_id, probe_id, content_hash), one row per match.

    A hash held by very many documents stays a long table; ordering newest first is left to the reader.
    """
    stored = documents.select("case_id", "content_hash", "document_id", "created_ord")
    return probes.select("case_id", "probe_id", "content_hash").join(stored, ["case_id", "content_hash"])


def duplicate_counts(probes: DataFrame, documents: DataFrame) -> DataFrame:
    """Number of matches and the newest one per probe; the documents are counted before the join."""
    per_hash = documents.groupBy("case_id", "content_hash").agg(
        F.count(F.lit(1)).alias("match_count"), F.max_by("document_id", "created_ord").alias("newest_match")
    )
    joined = probes.join(per_hash, ["case_id", "content_hash"], "left")
    return joined.select("case_id", "probe_id", F.coalesce("match_count", F.lit(0)).alias("match_count"), "newest_match")


def intake_decisions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """accepted / bad_hash / hash_mismatch / duplicate per incoming document.

    incoming(case_id, document_id, content_hash, claimed_hash, allow_duplicate, created_ord). Of equal
    documents in one batch the earliest is taken, unless duplicates are allowed.
    """
    claimed = F.lower(strip(F.col("claimed_hash")))
    checked = incoming.withColumn(
        "_fault",
        F.when(claimed.isNotNull() & ~claimed.rlike("^[0-9a-f]{64}$"), "bad_hash")
        .when(claimed.isNotNull() & (claimed != F.col("content_hash")), "hash_mismatch"),
    )
    sound = checked.filter(F.col("_fault").isNull())
    first = sound.groupBy("case_id", "content_hash").agg(F.min("created_ord").alias("_first"))
    known = stored.select("case_id", "content_hash").distinct().withColumn("_known", F.lit(True))
    judged = checked.join(first, ["case_id", "content_hash"], "left").join(known, ["case_id", "content_hash"], "left")
    repeated = (F.coalesce("_known", F.lit(False)) | (F.col("created_ord") > F.col("_first"))) & ~F.col("allow_duplicate")
    decision = F.coalesce("_fault", F.when(repeated, "duplicate").otherwise("accepted"))
    return judged.select("case_id", "document_id", "content_hash", decision.alias("decision"))


def _newest(value: Column, *order: Column) -> Column:
    return F.max_by(value, F.struct(*order))


def document_listing(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with the processing mode of their newest complete job."""
    done = jobs.filter(F.col("status") == "complete")
    when = F.coalesce("finished_at", "started_at", F.lit("1900-01-01").cast("timestamp"))
    latest = done.groupBy("case_id", "document_id").agg(_newest(F.col("processing_mode"), when, F.col("job_id")).alias("latest_processing_mode"))
    return documents.join(latest, ["case_id", "document_id"], "left")


def summary_snippet(text: Column) -> Column:
    return F.nullif(clip(squeeze(text), SNIPPET_LIMIT), F.lit(""))


def case_directory(cases: DataFrame, documents: DataFrame, jobs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Cases with document count, active jobs and the summary's snippet."""
    n = F.count(F.lit(1))
    active = jobs.filter(F.col("status").isin(ACTIVE_STATES)).groupBy("case_id").agg(n.alias("active_job_count"))
    out = cases.join(documents.groupBy("case_id").agg(n.alias("doc_count")), "case_id", "left").join(active, "case_id", "left")
    out = out.join(summaries.select("case_id", summary_snippet(F.col("summary_text")).alias("summary_snippet")), "case_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("doc_count", "active_job_count")})


def filter_cases(cases: DataFrame, status: str = "all", needle: str = "") -> DataFrame:
    text = needle.strip().lower()
    kept = cases if status == "all" else cases.filter(F.col("status") == status)
    return kept.filter(F.lower("name").contains(text) | F.lower("case_slug").contains(text)) if text else kept


def filter_jobs(jobs: DataFrame, documents: DataFrame, status: str = "all", needle: str = "") -> DataFrame:
    text = needle.strip().lower()
    kept = jobs if status == "all" else jobs.filter(F.col("status") == status)
    named = kept.join(documents.select("case_id", "document_id", "original_filename"), ["case_id", "document_id"], "left")
    found = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text) for c in ("job_id", "status", "original_filename")]
    return named.filter(found[0] | found[1] | found[2]) if text else named


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Job with the newest start per document."""
    fields = [c for c in jobs.columns if c not in ("case_id", "document_id")]
    newest = jobs.groupBy("case_id", "document_id").agg(_newest(F.struct(*fields), F.col("started_at"), F.col("job_id")).alias("job"))
    return newest.select("case_id", "document_id", *[F.col(f"job.{c}").alias(c) for c in fields])


def progress_counters(documents: DataFrame) -> DataFrame:
    status = F.lower("ingestion_status")
    return documents.groupBy("case_id").agg(
        F.count_if(status.isin(COMPLETE_STATES)).alias("completed"), F.count_if(~status.isin(TERMINAL_STATES)).alias("processing"),
        F.count(F.lit(1)).alias("total"),
    )


def base_summary(cases: DataFrame, documents: DataFrame, jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Document counts, latest activity and latest complete job of every case, next to its graph metrics."""
    status = F.lower("ingestion_status")
    docs = documents.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("document_count"), F.count_if(status.isin(COMPLETE_STATES)).alias("completed_document_count"),
        F.max("updated_at").alias("_touched"),
    )
    done = jobs.filter(F.col("status") == "complete").groupBy("case_id").agg(_newest(F.col("job_id"), F.col("finished_at"), F.col("job_id")).alias("source_job_id"))
    out = cases.join(docs, "case_id", "left").join(done, "case_id", "left").join(metrics, "case_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("document_count", "completed_document_count", *[c for c in metrics.columns if c != "case_id"])}
    return out.withColumns(zero).withColumn("latest_activity_at", F.greatest("updated_at", "_touched")).drop("_touched", "updated_at")


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "normal", 1).otherwise(2)


def next_jobs(jobs: DataFrame, busy_cases: DataFrame | None = None) -> DataFrame:
    """First queued job per case by priority and start; cases at work are left out."""
    queued = jobs.filter((F.col("status") == "queued") & (F.col("case_id") != ""))
    if busy_cases is not None:
        queued = queued.join(busy_cases.select("case_id"), "case_id", "left_anti")
    order = F.struct(priority_rank(F.col("queue_priority")), "started_at", "job_id")
    return queued.groupBy("case_id").agg(F.min_by(F.struct("job_id", "queue_priority", "started_at"), order).alias("j")).select("case_id", "j.*")


def cases_with_other_pending_jobs(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """finished(case_id, job_id) rows whose case still has another active job."""
    pending = jobs.filter(F.col("status").isin(ACTIVE_STATES)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    own = jobs.filter(F.col("status").isin(ACTIVE_STATES)).select("case_id", "job_id", F.lit(1).alias("own"))
    both = finished.join(pending, "case_id").join(own, ["case_id", "job_id"], "left")
    return both.filter(F.col("n") > F.coalesce("own", F.lit(0))).select("case_id", "job_id")


def chat_history(messages: DataFrame, length: int = HISTORY_LENGTH) -> DataFrame:
    """Last user and assistant messages of each chat in time order; turn_rank 1 is the newest."""
    spoken = messages.withColumns({"role": strip(F.col("role")), "content": strip(F.col("content"))}).filter(
        F.col("role").isin("user", "assistant") & (F.col("content") != ""))
    return top_per_key(spoken, ["chat_id"], [F.col("created_ord").desc()], length, "turn_rank")


def awaiting_chats(messages: DataFrame) -> DataFrame:
    """Chats whose last message is the user's."""
    last = messages.groupBy("chat_id").agg(F.max_by("role", "created_ord").alias("role"))
    return last.filter(F.trim("role") == "user").select("chat_id")


def stage_usage(traces: DataFrame) -> DataFrame:
    """Calls, tokens, latency and errors per stage and model; the 95th percentile is a latency that occurs, and exact.

    Equal latencies are counted together where they lie, then placed by a running count that no single task makes.
    """
    own, key = F.col("latency_ms"), F.struct("stage", "model").alias("of")  # nulls within a struct are equal
    counts = traces.groupBy(key, "latency_ms").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("total_tokens").alias("total_tokens"),
        F.count(own).alias("timed"), F.sum(own).alias("latency"))
    placed = number_rows(counts, ["of"], ["latency_ms"], "upto", "timed")
    sums = placed.groupBy("of").agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("total_tokens").alias("total_tokens"),
        F.try_divide(F.sum("latency"), F.sum("timed")).alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.sum("timed").alias("timed"))
    reached = placed.join(sums.select("of", F.expr("timed - timed * 5 div 100").alias("least")), "of").filter(own.isNotNull() & (F.col("upto") >= F.col("least")))
    return sums.join(reached.groupBy("of").agg(F.min("latency_ms").alias("p95_latency_ms")), "of", "left").select(
        "of.*", "calls", "errors", "total_tokens", "mean_latency_ms", "max_latency_ms", "p95_latency_ms")


def running_usage(traces: DataFrame) -> DataFrame:
    """stage_usage() of a stream, in a state that stays small: the 95th percentile is that of a sketch."""
    return traces.groupBy("stage", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum("total_tokens").alias("total_tokens"), F.avg("latency_ms").alias("mean_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"), F.percentile_approx("latency_ms", 0.95).alias("p95_latency_ms"),
    )


def carry_over_summary(base: DataFrame, reply: DataFrame, previous: DataFrame) -> DataFrame:
    """Figures come from base; texts from the model's reply, else from the stored summary when there was no reply."""
    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select("case_id", *[F.col(c).alias(f"_{mark}_{c}") for c in SUMMARY_TEXTS], F.lit(True).alias(f"_{mark}"))

    joined = base.join(side(reply, "new"), "case_id", "left").join(side(previous, "old"), "case_id", "left")
    return joined.select(
        *base.columns,
        *[F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in SUMMARY_TEXTS],
        F.when(F.col("_new"), "fresh").when(F.col("_old"), "kept").otherwise("none").alias("summary_state"),
    )


def distinct_unknowns(unknowns: DataFrame, limit: int = UNKNOWNS_LIMIT) -> DataFrame:
    """First distinct (without case) unknowns per case; unknowns(case_id, ord, text)."""
    text = strip(F.col("text"))
    firsts = unknowns.filter(text != "").groupBy("case_id", F.lower(text).alias("key")).agg(
        F.min_by(text, F.col("ord")).alias("text"), F.min("ord").alias("ord"))
    return top_per_key(firsts, ["case_id"], [F.col("ord")], limit).select("case_id", "rank", "text")


def newest_first(documents: DataFrame) -> DataFrame:
    """Running number per case, newest document first, for paged listings of any size."""
    numbered = number_rows(documents.withColumn("_back", -F.col("created_ord")), ["case_id"], ["_back"], "rank")
    return numbered.drop("_back")
