"""Document, job, case and chat queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import documents as dc
from caseloom.plans.bindings import CASES_SQL, CASE_DOCUMENTS_SQL, CASE_JOBS_SQL, NONE, case_documents, case_jobs, cases, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def corpus(spark, sf):
    """All documents as one case, where copies across sources meet."""
    return case_documents(spark, sf).withColumn("case_id", F.lit("corpus"))


@query("dup_check", f"""WITH {CASE_DOCUMENTS_SQL} SELECT 'corpus' AS case_id, content_hash, document_id AS probe_id, n AS match_count, newest AS newest_match FROM case_documents
JOIN (SELECT content_hash, count(*) AS n, arg_max(document_id, created_ord) AS newest FROM case_documents GROUP BY 1) USING (content_hash)""".replace("content_hash, document_id AS", "document_id AS"))
def dup_check(spark, sf):
    docs = corpus(spark, sf)
    return dc.duplicate_counts(docs.withColumnRenamed("document_id", "probe_id").select("case_id", "probe_id", "content_hash"), docs)


@query("dup_matches", f"""WITH {CASE_DOCUMENTS_SQL}, probes AS (SELECT content_hash, 'P' || min(doc_id) AS probe_id FROM case_documents GROUP BY 1 HAVING count(*) > 1)
SELECT 'corpus' AS case_id, content_hash, probe_id, document_id, created_ord FROM probes JOIN case_documents USING (content_hash)""")
def dup_matches(spark, sf):
    docs = corpus(spark, sf)
    probes = docs.groupBy("case_id", "content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("created_ord").alias("m")).filter("n > 1").selectExpr(
        "case_id", "content_hash", "'P' || m as probe_id")
    return dc.duplicate_matches(probes, docs)


@query("dup_reject", f"""WITH {CASE_DOCUMENTS_SQL}, incoming AS (SELECT *, CASE WHEN doc_id % 10 = 1 THEN 'nohash' WHEN doc_id % 10 = 2 THEN sha256(document_id) WHEN doc_id % 10 = 3 THEN upper(content_hash) END AS claimed FROM case_documents),
judged AS (SELECT *, CASE WHEN claimed = 'nohash' THEN 'bad_hash' WHEN lower(claimed) <> content_hash THEN 'hash_mismatch' END AS fault FROM incoming)
SELECT 'corpus' AS case_id, document_id, content_hash, coalesce(fault, CASE WHEN doc_id % 7 <> 0 AND (content_hash IN (SELECT content_hash FROM case_documents WHERE lang = 'fr') OR
 doc_id > (SELECT min(doc_id) FROM judged f WHERE f.content_hash = j.content_hash AND fault IS NULL)) THEN 'duplicate' ELSE 'accepted' END) AS decision FROM judged j""")
def dup_reject(spark, sf):
    docs = corpus(spark, sf)
    incoming = docs.withColumn("allow_duplicate", F.expr("created_ord % 7 = 0")).withColumn(
        "claimed_hash", F.expr("case created_ord % 10 when 1 then 'nohash' when 2 then sha2(document_id, 256) when 3 then upper(content_hash) end"))
    return dc.intake_decisions(incoming, docs.filter("tags = 'fr'"))


@query("doc_latest_mode", f"""WITH {CASE_DOCUMENTS_SQL}, {CASE_JOBS_SQL} SELECT case_id, document_id, (SELECT processing_mode FROM case_jobs j WHERE j.document_id = d.document_id AND j.case_id = d.case_id AND j.status = 'complete'
ORDER BY coalesce(finished_at, started_at) DESC, job_id DESC LIMIT 1) AS latest_processing_mode FROM case_documents d""")
def doc_latest_mode(spark, sf):
    return dc.document_listing(case_documents(spark, sf).select("case_id", "document_id"), case_jobs(spark, sf))


@query("doc_latest_job", f"""WITH {CASE_JOBS_SQL} SELECT case_id, document_id, job_id, status, queue_priority FROM case_jobs QUALIFY row_number() OVER (PARTITION BY case_id, document_id ORDER BY started_at DESC, job_id DESC) = 1""")
def doc_latest_job(spark, sf):
    return dc.latest_jobs(case_jobs(spark, sf)).select("case_id", "document_id", "job_id", "status", "queue_priority")


def case_texts(spark, sf):
    """Longest document of a case as its summary text."""
    return table(spark, sf, "documents").groupBy(F.col("source").alias("case_id")).agg(F.max_by("text", F.struct("n_chars", "doc_id")).alias("summary_text"))


@query("case_directory", rf"""WITH {CASES_SQL}, {CASE_DOCUMENTS_SQL}, {CASE_JOBS_SQL}, s AS (SELECT source AS case_id, trim(regexp_replace(arg_max(text, (n_chars, doc_id)), '\s+', ' ', 'g')) AS t FROM documents GROUP BY 1)
SELECT c.case_id, name, status, (SELECT count(*) FROM case_documents d WHERE d.case_id = c.case_id) AS doc_count,
(SELECT count(*) FROM case_jobs j WHERE j.case_id = c.case_id AND j.status IN ('queued', 'parsing', 'inserting', 'indexing')) AS active_job_count,
CASE WHEN length(t) > 220 THEN rtrim(left(t, 217)) || '...' ELSE t END AS summary_snippet FROM cases c LEFT JOIN s USING (case_id)""")
def case_directory(spark, sf):
    out = dc.case_directory(cases(spark, sf), case_documents(spark, sf), case_jobs(spark, sf), case_texts(spark, sf))
    return out.select("case_id", "name", "status", "doc_count", "active_job_count", "summary_snippet")


@query("case_filter", f"WITH {CASES_SQL} SELECT case_id, name FROM cases WHERE status = 'open' AND contains(lower(name), 'src1')")
def case_filter(spark, sf):
    return dc.filter_cases(cases(spark, sf), "open", " SRC1 ").select("case_id", "name")


@query("job_filter", f"WITH {CASE_JOBS_SQL} SELECT case_id, document_id, job_id, status, substr(document_id, 2) || '.txt' AS original_filename FROM case_jobs WHERE contains(job_id::VARCHAR, '7.t') OR contains(substr(document_id, 2) || '.txt', '7.t')")
def job_filter(spark, sf):
    return dc.filter_jobs(case_jobs(spark, sf), case_documents(spark, sf), "all", "7.T").select("case_id", "document_id", "job_id", "status", "original_filename")


@query("progress", f"""WITH {CASE_DOCUMENTS_SQL} SELECT case_id, count(*) FILTER (ingestion_status = 'complete') AS completed, count(*) FILTER (ingestion_status = 'queued') AS processing, count(*) AS total FROM case_documents GROUP BY 1""")
def progress(spark, sf):
    return dc.progress_counters(case_documents(spark, sf))


@query("base_summary", f"""WITH {CASES_SQL}, {CASE_DOCUMENTS_SQL}, {CASE_JOBS_SQL} SELECT case_id, document_count, completed_document_count, entity_count,
strftime(greatest(updated_at, TIMESTAMP '2023-01-01' + INTERVAL 1 DAY * 2 * last), '%Y-%m-%d') AS latest_activity, (SELECT arg_max(job_id, (coalesce(finished_at, TIMESTAMP '1900-01-01'), job_id)) FROM case_jobs j WHERE j.case_id = c.case_id AND status = 'complete') AS source_job_id
FROM cases c JOIN (SELECT case_id, count(*) AS document_count, count(*) FILTER (ingestion_status = 'complete') AS completed_document_count, count(DISTINCT lang) AS entity_count, max(doc_id) AS last FROM case_documents GROUP BY 1) USING (case_id)""")
def base_summary(spark, sf):
    docs = case_documents(spark, sf).withColumn("updated_at", F.expr("timestamp '2023-01-01' + make_interval(0, 0, 0, cast(2 * created_ord as int))"))
    metrics = docs.groupBy("case_id").agg(F.countDistinct("tags").alias("entity_count"))
    out = dc.base_summary(cases(spark, sf), docs, case_jobs(spark, sf), metrics)
    return out.select("case_id", "document_count", "completed_document_count", "entity_count", F.date_format("latest_activity_at", "yyyy-MM-dd").alias("latest_activity"), "source_job_id")


@query("job_queue", f"""WITH {CASE_JOBS_SQL} SELECT case_id, job_id, queue_priority FROM case_jobs WHERE status = 'queued' AND case_id NOT IN (SELECT case_id FROM case_jobs GROUP BY 1 HAVING arg_max(status, (started_at, job_id)) = 'parsing')
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY CASE queue_priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, started_at, job_id) = 1""")
def job_queue(spark, sf):
    jobs = case_jobs(spark, sf)
    newest = jobs.groupBy("case_id").agg(F.max_by("status", F.struct("started_at", "job_id")).alias("status"))
    return dc.next_jobs(jobs, newest.filter("status = 'parsing'")).select("case_id", "job_id", "queue_priority")


@query("pending_jobs", f"""WITH {CASE_JOBS_SQL} SELECT case_id, job_id FROM case_jobs j WHERE EXISTS (SELECT 1 FROM case_jobs o WHERE o.case_id = j.case_id AND o.job_id <> j.job_id AND o.status IN ('queued', 'parsing', 'inserting', 'indexing'))""")
def pending_jobs(spark, sf):
    jobs = case_jobs(spark, sf)
    return dc.cases_with_other_pending_jobs(jobs, jobs.select("case_id", "job_id"))


def messages(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("chat_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_ord"))


@query("history_window", """SELECT conv_id AS chat_id, turn AS created_ord, role, turn_rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS turn_rank FROM conversations
WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE turn_rank <= 24""")
def history_window(spark, sf):
    return dc.chat_history(messages(spark, sf)).select("chat_id", "created_ord", "role", "turn_rank")


@query("awaiting_chats", "SELECT conv_id AS chat_id FROM conversations GROUP BY 1 HAVING arg_max(role, turn) = 'user'")
def awaiting_chats(spark, sf):
    return dc.awaiting_chats(messages(spark, sf))


def traces(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_type as stage", "'model-' || user_id % 3 as model", "value as latency_ms", "cast(get_json_object(props, '$.k') as long) as total_tokens",
        f"case when event_type = 'error' then 'failed' else {NONE} end as error", "ts as created_at")


@query("stage_usage", """SELECT event_type AS stage, 'model-' || user_id % 3 AS model, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors,
sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total_tokens, round(avg(value), 6) AS mean_latency_ms, max(value) AS max_latency_ms, quantile_disc(value, 0.95) AS p95_latency_ms FROM events GROUP BY 1, 2""")
def stage_usage(spark, sf):
    return dc.stage_usage(traces(spark, sf)).withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


@query("summary_carry", f"""WITH {CASES_SQL}, t AS (SELECT source AS case_id, arg_max(text, (n_chars, doc_id)) AS summary_text, arg_min(text, (n_chars, doc_id)) AS old_text, max(doc_id) AS m FROM documents GROUP BY 1)
SELECT case_id, name, CASE WHEN m % 3 = 0 THEN summary_text WHEN m % 3 = 1 THEN old_text END AS summary_text, CASE WHEN m % 3 = 1 THEN 'kept investigation' END AS investigation_summary,
CASE m % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'kept' ELSE 'none' END AS summary_state FROM cases JOIN t USING (case_id)""")
def summary_carry(spark, sf):
    texts = table(spark, sf, "documents").groupBy(F.col("source").alias("case_id")).agg(
        F.max_by("text", F.struct("n_chars", "doc_id")).alias("new"), F.min_by("text", F.struct("n_chars", "doc_id")).alias("old"), F.max("doc_id").alias("m"))
    reply = texts.filter("m % 3 = 0").selectExpr("case_id", f"{NONE} as intelligence_summary", f"{NONE} as investigation_summary", "new as summary_text")
    previous = texts.filter("m % 3 < 2").selectExpr("case_id", f"{NONE} as intelligence_summary", "'kept investigation' as investigation_summary", "old as summary_text")
    out = dc.carry_over_summary(cases(spark, sf).select("case_id", "name"), reply, previous)
    return out.select("case_id", "name", "summary_text", "investigation_summary", "summary_state")


@query("unknown_list", """WITH w AS (SELECT 'k' || user_id % 5 AS case_id, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN upper(event_type || value::INT) ELSE event_type || value::INT END AS text FROM events),
f AS (SELECT case_id, lower(text) AS k, arg_min(text, ord) AS text, min(ord) AS ord FROM w GROUP BY 1, 2) SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS rank, text FROM f QUALIFY rank <= 20""".replace("value::INT", "floor(value)::INT"))
def unknown_list(spark, sf):
    rows = table(spark, sf, "events").selectExpr("'k' || user_id % 5 as case_id", "event_id as ord",
        "' ' || case when event_id % 2 = 0 then upper(event_type || cast(floor(value) as int)) else event_type || cast(floor(value) as int) end as text")
    return dc.distinct_unknowns(rows)


@query("newest_documents", f"""WITH {CASE_DOCUMENTS_SQL} SELECT case_id, document_id, row_number() OVER (PARTITION BY case_id ORDER BY created_ord DESC) AS rank FROM case_documents""")
def newest_documents(spark, sf):
    return dc.newest_first(case_documents(spark, sf).select("case_id", "document_id", "created_ord")).select("case_id", "document_id", "rank")
