"""Metrics and golden-set queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import evaluate as ev, goldens as gd
from caseloom.plans.bindings import CASE_DOCUMENTS_SQL, DOCUMENT_CHUNKS_SQL, NONE, case_documents, document_chunks, table
from caseloom.plans.retrieval_queries import BASE_SQL, entity_hits
from caseloom.session import with_next

QUERIES, ORACLE = {}, {}
THRESHOLD = 0.5


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


# --- source files: every case asks for its complete documents and gets those not labelled toxic ---

def source_questions(spark, sf):
    docs = case_documents(spark, sf)
    questions = docs.select(F.col("case_id").alias("query_id")).distinct()
    expected = docs.filter("ingestion_status = 'complete'").selectExpr("case_id as query_id", "stored_file_path as path")
    returned = docs.filter("substr(confidence_code, 2) <> '3'").selectExpr(
        "case_id as query_id", "'/x/0f8fad5b-d9cb-469f-a165-70867728950e_' || case when created_ord % 2 = 0 then 'copy of ' else '' end || original_filename as path", "created_ord as pos", "'r' || created_ord as reference_id")
    return questions, expected, returned


SOURCE_SQL = f"""{CASE_DOCUMENTS_SQL}, want AS (SELECT DISTINCT case_id, doc_id || ' txt' AS k FROM case_documents WHERE ingestion_status = 'complete'),
have AS (SELECT DISTINCT case_id, CASE WHEN doc_id % 2 = 0 THEN 'copy of ' ELSE '' END || doc_id || ' txt' AS k, doc_id FROM case_documents WHERE substr(confidence_code, 2) <> '3'),
hit AS (SELECT DISTINCT w.case_id, w.k FROM want w JOIN have h ON h.case_id = w.case_id AND (contains(w.k, h.k) OR contains(h.k, w.k))),
n AS (SELECT c.case_id, (SELECT count(*) FROM want w WHERE w.case_id = c.case_id) AS e, (SELECT count(*) FROM have h WHERE h.case_id = c.case_id) AS r, (SELECT count(*) FROM hit h WHERE h.case_id = c.case_id) AS m FROM (SELECT DISTINCT case_id FROM case_documents) c)"""


@query("eval_source", f"""WITH {SOURCE_SQL} SELECT case_id AS query_id, e AS expected_count, r AS returned_count, m AS matched_count, CASE WHEN e > 0 THEN round(m / e, 4) END AS source_recall,
CASE WHEN r > 0 THEN round(m / r, 4) END AS source_precision, CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END AS source_hit FROM n""")
def eval_source(spark, sf):
    return ev.source_metrics(*source_questions(spark, sf))


@query("eval_citations", f"""WITH {SOURCE_SQL}, cited AS (SELECT * FROM have WHERE doc_id % 3 = 0),
cited_hit AS (SELECT DISTINCT w.case_id, w.k FROM want w JOIN cited h ON h.case_id = w.case_id AND (contains(w.k, h.k) OR contains(h.k, w.k))),
c AS (SELECT n.*, (SELECT count(*) FROM cited h WHERE h.case_id = n.case_id) AS cn, (SELECT count(*) FROM cited_hit h WHERE h.case_id = n.case_id) AS cm FROM n)
SELECT case_id AS query_id, cn AS cited_count, cm AS matched_citation_count, CASE WHEN e > 0 THEN round(cm / e, 4) END AS citation_recall,
CASE WHEN e = 0 THEN CASE WHEN cn = 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(round(cm / nullif(cn, 0), 4), 0) END AS citation_precision, CASE WHEN e > 0 THEN CASE WHEN cm > 0 THEN 1.0 ELSE 0.0 END END AS citation_hit,
e AS expected_count, r AS returned_count, m AS matched_count, CASE WHEN e > 0 THEN round(m / e, 4) END AS provenance_recall,
CASE WHEN e = 0 THEN CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END ELSE coalesce(round(m / nullif(r, 0), 4), 0) END AS provenance_precision, CASE WHEN e > 0 THEN CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END END AS provenance_hit FROM c""")
def eval_citations(spark, sf):
    questions, expected, returned = source_questions(spark, sf)
    numbered = returned.withColumn("reference_id", F.col("pos").cast("string"))
    marks = numbered.filter("pos % 3 = 0").groupBy("query_id").agg(F.array_join(F.collect_list(F.concat(F.lit("as in ["), "reference_id", F.lit("]"))), " ").alias("answer"))
    asked = questions.join(marks, "query_id", "left").withColumn("answer", F.concat(F.coalesce("answer", F.lit("")), F.lit(" and [999999999] or [x].")))
    return ev.citation_metrics(asked, expected, numbered)


# --- entities and relations: a label's vectors are expected, its mean vector's neighbours retrieved ---

def entity_sides(spark, sf):
    items = table(spark, sf, "embeddings").selectExpr("vec_id", "'q' || label as query_id", "'E' || vec_id as key", "embedding as vector")
    retrieved = entity_hits(spark, sf).select("query_id", F.col("item_id").alias("key")).join(items.select("key", "vector"), "key")
    return items.select("query_id").distinct(), items.select("query_id", "key", "vector"), retrieved


ENTITY_SQL = f"""{BASE_SQL}, want AS (SELECT 'q' || label AS query_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
have AS (SELECT query_id, vec_id, embedding::DOUBLE[] AS w FROM ent JOIN embeddings ON item_id = 'E' || vec_id),
q AS (SELECT DISTINCT query_id FROM want)"""


@query("eval_entities", f"""WITH {ENTITY_SQL}, near AS (SELECT w.query_id, w.vec_id AS e, h.vec_id AS r FROM want w JOIN have h ON h.query_id = w.query_id WHERE list_cosine_similarity(v, w) >= {THRESHOLD}),
n AS (SELECT query_id, (SELECT count(*) FROM want x WHERE x.query_id = q.query_id) AS e, (SELECT count(*) FROM have x WHERE x.query_id = q.query_id) AS r, (SELECT count(DISTINCT e) FROM near x WHERE x.query_id = q.query_id) AS m,
 (SELECT count(DISTINCT r) FROM near x WHERE x.query_id = q.query_id) AS p, (SELECT count(*) FROM want x JOIN have y ON x.query_id = y.query_id AND x.vec_id = y.vec_id WHERE x.query_id = q.query_id) AS x FROM q)
SELECT query_id, e AS expected_entity_count, r AS retrieved_entity_count, m AS matched_entity_count, round(m / e, 4) AS entity_recall, CASE WHEN r > 0 THEN round(p / r, 4) END AS entity_precision,
round(x / e, 4) AS entity_recall_exact, CASE WHEN r > 0 THEN round(x / r, 4) END AS entity_precision_exact FROM n""")
def eval_entities(spark, sf):
    return ev.entity_matches(*entity_sides(spark, sf), THRESHOLD)


def relation_sides(spark, sf):
    """Expected: every vector and the next one of its label. Retrieved: neighbouring ranks of the hits."""
    from pyspark.sql import Window

    questions, expected, retrieved = entity_sides(spark, sf)
    ranked = entity_hits(spark, sf).select("query_id", F.col("item_id").alias("key"), "rank").join(retrieved, ["query_id", "key"])
    following = Window.partitionBy("query_id").orderBy("rank")
    have = ranked.select("query_id", F.col("key").alias("src"), F.lead("key").over(following).alias("tgt"), F.col("vector").alias("src_vector"), F.lead("vector").over(following).alias("tgt_vector")).filter("tgt is not null")
    vectors = table(spark, sf, "embeddings")
    pairs = with_next(vectors.select("label", "vec_id"), ["label"], ["vec_id"], "vec_id", "next_id").filter("next_id is not null")
    want = pairs.join(vectors.select("vec_id", F.col("embedding").alias("src_vector")), "vec_id").join(
        vectors.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("tgt_vector")), "next_id"
    ).selectExpr("'q' || label as query_id", "'E' || vec_id as src", "'E' || next_id as tgt", "src_vector", "tgt_vector")
    return questions, want, have, retrieved


RELATION_SQL = f"""{ENTITY_SQL}, wr AS (SELECT * FROM (SELECT 'q' || label AS query_id, vec_id AS src, embedding::DOUBLE[] AS vs, lead(vec_id) OVER c AS tgt, lead(embedding::DOUBLE[]) OVER c AS vt FROM embeddings WINDOW c AS (PARTITION BY label ORDER BY vec_id)) WHERE tgt IS NOT NULL),
hr AS (SELECT * FROM (SELECT query_id, vec_id AS src, embedding::DOUBLE[] AS ws, lead(vec_id) OVER c AS tgt, lead(embedding::DOUBLE[]) OVER c AS wt FROM ent JOIN embeddings ON item_id = 'E' || vec_id WINDOW c AS (PARTITION BY query_id ORDER BY rank)) WHERE tgt IS NOT NULL)"""


@query("eval_relations", f"""WITH {RELATION_SQL}, near AS (SELECT wr.query_id, wr.src AS e, hr.src AS r FROM wr JOIN hr ON hr.query_id = wr.query_id
WHERE greatest(least(list_cosine_similarity(vs, ws), list_cosine_similarity(vt, wt)), least(list_cosine_similarity(vs, wt), list_cosine_similarity(vt, ws))) >= {THRESHOLD}),
n AS (SELECT query_id, (SELECT count(*) FROM wr x WHERE x.query_id = q.query_id) AS e, (SELECT count(*) FROM hr x WHERE x.query_id = q.query_id) AS r, (SELECT count(DISTINCT e) FROM near x WHERE x.query_id = q.query_id) AS m, (SELECT count(DISTINCT r) FROM near x WHERE x.query_id = q.query_id) AS p,
 (SELECT count(*) FROM wr x WHERE x.query_id = q.query_id AND EXISTS (SELECT 1 FROM hr y WHERE y.query_id = x.query_id AND ((y.src = x.src AND y.tgt = x.tgt) OR (y.src = x.tgt AND y.tgt = x.src)))) AS x FROM q)
SELECT query_id, e AS expected_relation_count, r AS retrieved_relation_count, m AS matched_relation_count, CASE WHEN e > 0 THEN round(m / e, 4) END AS relation_recall, CASE WHEN r > 0 THEN round(p / r, 4) END AS relation_precision,
CASE WHEN e > 0 THEN round(x / e, 4) END AS relation_recall_exact, CASE WHEN r > 0 THEN round(x / r, 4) END AS relation_precision_exact FROM n""")
def eval_relations(spark, sf):
    questions, want, have, _ = relation_sides(spark, sf)
    return ev.relation_matches(questions, want, have, THRESHOLD)


CONNECTED_SQL = f"""{RELATION_SQL}, present AS (SELECT DISTINCT w.query_id, w.vec_id FROM want w JOIN have h ON h.query_id = w.query_id WHERE list_cosine_similarity(v, w) >= {THRESHOLD}),
conn AS (SELECT q.query_id, CASE WHEN count(src) > 0 THEN round(count(src) FILTER (a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL) / count(src), 4) END AS relation_connectivity_recall
FROM q LEFT JOIN wr ON wr.query_id = q.query_id LEFT JOIN present a ON a.query_id = wr.query_id AND a.vec_id = src LEFT JOIN present b ON b.query_id = wr.query_id AND b.vec_id = tgt GROUP BY 1)"""


@query("eval_connectivity", f"WITH {CONNECTED_SQL} SELECT * FROM conn")
def eval_connectivity(spark, sf):
    questions, want, _, retrieved = relation_sides(spark, sf)
    return ev.connectivity_recall(questions, want, retrieved, THRESHOLD)


METRICS = [f"{kind}_{m}" for kind in ("entity", "relation") for m in ("recall", "precision", "recall_exact", "precision_exact")]
METRICS += [f"{part}_{kind}_count" for kind in ("entity", "relation") for part in ("retrieved", "matched")] + ["relation_connectivity_recall"]


@query("eval_graph_rows", f"""SELECT query_id, CASE WHEN query_id IN ('q1', 'q4') THEN 'naive' ELSE 'hybrid' END AS mode, query_id IN ('q2', 'q5') AS out_of_scope, expected_entity_count, expected_relation_count,
{', '.join(f"CASE WHEN query_id NOT IN ('q1', 'q2', 'q4', 'q5') THEN {m} END AS {m}" for m in METRICS)}
FROM ({ORACLE["eval_entities"]}) JOIN ({ORACLE["eval_relations"]}) USING (query_id) JOIN ({ORACLE["eval_connectivity"]}) USING (query_id)""")
def eval_graph_rows(spark, sf):
    connected = eval_connectivity(spark, sf)
    questions = connected.selectExpr("query_id", "case when query_id in ('q1', 'q4') then 'naive' else 'hybrid' end as mode", "query_id in ('q2', 'q5') as out_of_scope")
    return ev.graph_metric_rows(questions, eval_entities(spark, sf), eval_relations(spark, sf), connected)


@query("eval_contexts", r"""WITH t AS (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN x = '' THEN 0 ELSE 1 END + 2 AS n, CASE WHEN x = '' THEN '' ELSE left(x, 100) || '|' END || left('Graph entities: ' || role || ' (said ' || turn || '); nobody', 100) || '|' || left('Graph relationships: ' || role || ' → ? → c' || conv_id || ' (x)', 100) AS contexts, CASE WHEN turn % 2 = 0 THEN x ELSE 'ref ' || turn END AS reference
FROM (SELECT t.*, role FROM t JOIN conversations c USING (conv_id, turn))""")
def eval_contexts(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("entities", F.expr("array(named_struct('name', role, 'description', 'said ' || turn), named_struct('name', 'nobody', 'description', ''))")).withColumn(
        "relations", F.expr(f"array(named_struct('src_id', role, 'relation_type', {NONE}, 'tgt_id', 'c' || conv_id, 'description', 'x'))"))
    contexts = ev.assemble_contexts(F.array(F.col("text"), F.lit(" "), F.lit(None).cast("string")), F.col("entities"), F.col("relations"), True, 100)
    chunks = F.when(F.col("turn") % 2 == 0, F.array("text", F.lit(" "))).otherwise(F.array().cast("array<string>"))
    reference = ev.evidence_reference(chunks, F.lit(" "), F.concat(F.lit("ref "), F.col("turn").cast("string")))
    return rows.select("conv_id", "turn", F.size(contexts).cast("long").alias("n"), F.array_join(contexts, "|").alias("contexts"), reference.alias("reference"))


@query("eval_summary", """SELECT event_type AS mode, user_id % 2 = 0 AS out_of_scope, count(*) AS n, round(avg(value) FILTER (event_id % 10 < 7), 4) AS source_recall, round(avg(json_extract_string(props, '$.k')::DOUBLE), 4) AS hit FROM events GROUP BY 1, 2""")
def eval_summary(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_type as mode", "user_id % 2 = 0 as out_of_scope", "get_json_object(props, '$.k') as hit",
        "case event_id % 10 when 7 then 'NaN' when 8 then 'Infinity' when 9 then 'n/a' else cast(value as string) end as source_recall")
    return ev.summary_by_mode(rows, ["source_recall", "hit"])


# --- golden sets ---------------------------------------------------------------------------------

SPEC_SQL = "spec AS (SELECT 'set-' || user_id % 3 AS dataset_id, ascii(event_type) AS type_ord, event_type AS analysis_type, 1 + user_id % 2 AS source_span, count(*) AS n FROM events GROUP BY ALL)"


def golden_spec(spark, sf):
    return table(spark, sf, "events").groupBy(
        F.expr("'set-' || user_id % 3").alias("dataset_id"), F.ascii("event_type").alias("type_ord"), F.col("event_type").alias("analysis_type"), (F.col("user_id") % 2 + 1).alias("source_span")
    ).agg(F.count(F.lit(1)).alias("count"))


@query("golden_schedule", f"""WITH {SPEC_SQL}, r AS (SELECT dataset_id, type_ord, analysis_type, source_span, unnest(range(1, n + 1)) AS c FROM spec), o AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY type_ord, source_span, c) AS i FROM r)
SELECT dataset_id, 'Q' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS id, analysis_type, source_span FROM o""")
def golden_schedule(spark, sf):
    return gd.schedule(golden_spec(spark, sf))


def golden_rows(spark, sf):
    """Every order as a golden question; its key decides which rule it breaks."""
    return table(spark, sf, "orders").selectExpr(
        "'orders' as dataset_id", "'Q' || o_orderkey as id", "array('link', 'temporal', 'flow', 'factual_verification', 'retrieval_honesty', 'gossip')[o_orderkey % 6] as analysis_type",
        "case when o_orderkey % 11 = 0 then array('generation') else array('retrieval', 'generation') end as phases", "case when o_orderkey % 13 = 0 then ' ' else 'Who placed order ' || o_orderkey || '?' end as question", "'C:' || o_custkey as reference_answer",
        "array(named_struct('name', 'C:' || o_custkey, 'type', case when o_orderkey % 7 = 0 then 'alien' else 'person' end), named_struct('name', 'O:' || o_orderkey, 'type', 'event')) as entities",
        "array(named_struct('src', case when o_orderkey % 5 = 0 then 'C:x' else 'C:' || o_custkey end, 'relation', case when o_orderkey % 3 = 0 then 'PLACED_2' else 'placed' end, 'tgt', 'O:' || o_orderkey)) as relations",
        "case when o_orderkey % 17 = 0 then cast(array() as array<string>) else array('text') end as chunks", "array('doc') as citation_targets", "o_orderstatus = 'P' as out_of_scope")


@query("golden_validate", """WITH g AS (SELECT o_orderkey AS k, 'Q' || o_orderkey AS id, o_orderstatus = 'P' AS oos FROM orders), e AS (SELECT id, 'invalid analysis_type' AS error FROM g WHERE k % 6 = 5
UNION ALL SELECT id, 'phases must be retrieval, generation' FROM g WHERE k % 11 = 0 UNION ALL SELECT id, 'question and reference_answer are required' FROM g WHERE k % 13 = 0
UNION ALL SELECT id, 'out-of-scope rows must be empty' FROM g WHERE oos UNION ALL SELECT id, 'entities, relationships and chunks are required' FROM g WHERE NOT oos AND k % 17 = 0
UNION ALL SELECT id, 'invalid entity' FROM g WHERE k % 7 = 0 UNION ALL SELECT id, 'relationship endpoint missing from entities' FROM g WHERE k % 5 = 0 UNION ALL SELECT id, 'invalid relationship label' FROM g WHERE k % 3 <> 0)
SELECT 'orders' AS dataset_id, id, error FROM e""")
def golden_validate(spark, sf):
    return gd.row_errors(golden_rows(spark, sf))


@query("golden_dataset", f"""WITH {SPEC_SQL}, g AS (SELECT 'set-' || user_id % 3 AS dataset_id, event_id AS ord, event_type AS analysis_type, 1 + user_id % 2 AS source_span, 'Is ' || user_id || ' ' || event_type || '?' AS q FROM events),
dup AS (SELECT dataset_id, 'duplicate question' AS error, lower(q) AS detail FROM g GROUP BY ALL HAVING count(*) > 1),
num AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ord) AS i FROM g),
want AS (SELECT dataset_id, analysis_type AS detail, sum(n) AS n FROM spec WHERE analysis_type <> 'error' GROUP BY 1, 2), have AS (SELECT dataset_id, analysis_type AS detail, count(*) AS n FROM g GROUP BY 1, 2),
wants AS (SELECT dataset_id, source_span::VARCHAR AS detail, sum(n) AS n FROM spec WHERE analysis_type <> 'error' GROUP BY 1, 2), haves AS (SELECT dataset_id, source_span::VARCHAR AS detail, count(*) AS n FROM g GROUP BY 1, 2)
SELECT * FROM dup UNION ALL SELECT dataset_id, 'non-sequential id', 'Q' || ord FROM num WHERE 'Q' || ord <> 'Q' || CASE WHEN i < 10 THEN '0' ELSE '' END || i
UNION ALL SELECT dataset_id, 'analysis_type distribution', detail FROM have FULL JOIN want USING (dataset_id, detail) WHERE have.n IS DISTINCT FROM want.n
UNION ALL SELECT dataset_id, 'source_span distribution', detail FROM haves FULL JOIN wants USING (dataset_id, detail) WHERE haves.n IS DISTINCT FROM wants.n""")
def golden_dataset(spark, sf):
    golden = table(spark, sf, "events").selectExpr("'set-' || user_id % 3 as dataset_id", "event_id as ord", "'Q' || event_id as id", "' Is ' || user_id || ' ' || event_type || '? ' as question", "event_type as analysis_type", "1 + user_id % 2 as source_span")
    return gd.dataset_errors(golden, gd.schedule(golden_spec(spark, sf).filter("analysis_type <> 'error'")))


PLAIN_MARKS = "".join(gd.PUNCTUATION.values()).replace("'", "''")
NORMAL = "trim(regexp_replace(translate(nfc_normalize({}), '" + "".join(gd.PUNCTUATION) + "', '" + PLAIN_MARKS + r"'), '\s+', ' ', 'g'))"


@query("span_in_source", f"""WITH d AS (SELECT 'D' || doc_id AS text_id, {NORMAL.format('text')} AS t FROM documents), s AS (SELECT item_id AS span_id, {NORMAL.format('text')} AS s FROM benchmark)
SELECT 'corpus' AS case_id, text_id, span_id FROM d JOIN s ON contains(t, s) WHERE s <> ''""")
def span_in_source(spark, sf):
    texts = case_documents(spark, sf).select(F.lit("corpus").alias("case_id"), F.col("document_id").alias("text_id"), "text")
    spans = table(spark, sf, "benchmark").select(F.lit("corpus").alias("case_id"), F.col("item_id").alias("span_id"), F.col("text").alias("span"))
    return gd.spans_in_sources(texts, spans, ["case_id"])


@query("span_with_gaps", f"""WITH d AS (SELECT 'D' || doc_id AS text_id, {NORMAL.format('text')} AS t FROM documents), w AS (SELECT item_id AS span_id, string_split({NORMAL.format('text')}, ' ') AS w FROM benchmark),
s AS (SELECT span_id, array_to_string(w[1:len(w) // 3], ' ') AS a, array_to_string(w[len(w) // 3 + 3:], ' ') AS b FROM w),
p AS (SELECT text_id, span_id, t, a, b, strpos(t, a) AS i FROM d JOIN s ON contains(t, a) AND contains(t, b))
SELECT 'corpus' AS case_id, text_id, span_id FROM p WHERE contains(substr(t, i + length(a)), b)""")
def span_with_gaps(spark, sf):
    texts = case_documents(spark, sf).select(F.lit("corpus").alias("case_id"), F.col("document_id").alias("text_id"), "text")
    words = table(spark, sf, "benchmark").select("item_id", F.split(gd.canonical_text(F.col("text")), " ").alias("w"))
    third = F.floor(F.size("w") / 3).cast("int")
    gapped = F.concat(F.array_join(F.slice("w", F.lit(1), third), " "), F.lit(" ... "), F.array_join(F.slice("w", third + 3, F.size("w")), " "))
    return gd.spans_in_sources(texts, words.select(F.lit("corpus").alias("case_id"), F.col("item_id").alias("span_id"), gapped.alias("span")), ["case_id"], True)


SEED = 20260521
SEEDED_SQL = f"('0x' || substr(md5('{SEED}-' || document_id), 1, 8))::BIGINT"


@query("context_sample", f"""WITH {CASE_DOCUMENTS_SQL}, {DOCUMENT_CHUNKS_SQL}, counts AS (SELECT case_id, document_id, count(*) AS n FROM chunks GROUP BY 1, 2),
started AS (SELECT *, least(n, 2) AS take, {SEEDED_SQL} % (n - least(n, 2) + 1) AS start FROM counts)
SELECT c.case_id, c.document_id, c.chunk_id FROM chunks c JOIN started s ON s.case_id = c.case_id AND s.document_id = c.document_id WHERE chunk_order >= start AND chunk_order < start + take""")
def context_sample(spark, sf):
    return gd.sample_context(document_chunks(spark, sf), 2, SEED).select("case_id", "document_id", "chunk_id")


@query("source_sample", f"WITH {CASE_DOCUMENTS_SQL} SELECT case_id, document_id FROM case_documents ORDER BY {SEEDED_SQL}, document_id LIMIT 25")
def source_sample(spark, sf):
    return gd.sample_sources(case_documents(spark, sf).select("case_id", "document_id"), 25, SEED)


@query("corpus_manifest", f"""WITH {CASE_DOCUMENTS_SQL} SELECT original_filename AS file_name, CASE WHEN lang = 'de' THEN 'added' WHEN lang = 'fr' THEN 'removed' ELSE 'changed' END AS change FROM case_documents WHERE lang IN ('de', 'fr') OR (lang = 'es' AND size_bytes > 1000)""")
def corpus_manifest(spark, sf):
    docs = case_documents(spark, sf)
    current = docs.filter("tags <> 'fr'").selectExpr("original_filename as file_name", "content_hash as sha256")
    previous = docs.filter("tags <> 'de'").selectExpr("original_filename as file_name", "case when tags = 'es' and size_bytes > 1000 then sha2(document_id, 256) else content_hash end as sha256")
    return gd.corpus_changes(current, previous)
