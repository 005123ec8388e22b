"""Provenance queries: how records find their documents, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import evidence as ev
from caseloom.plans.bindings import CASE_DOCUMENTS_SQL, DOCUMENT_CHUNKS_SQL, NONE, case_documents, document_chunks
from caseloom.session import with_next

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def present_files(spark, sf):
    """Files of failed documents are gone."""
    return case_documents(spark, sf).filter("ingestion_status <> 'failed'").select("case_id", F.col("stored_file_path").alias("path"))


def chunk_records(spark, sf):
    """Chunks of French documents know only a file name, the others name their document as well."""
    docs = case_documents(spark, sf).select("document_id", "tags", "original_filename")
    return document_chunks(spark, sf).join(docs, "document_id").selectExpr(
        "case_id", "'chunk' as owner_kind", "chunk_id as owner_key", "chunk_id as reference_id", f"{NONE} as confidence_code",
        f"case when tags = 'fr' then {NONE} else document_id end as record_document_id", "'/uploads/' || upper(original_filename) as file_hint")


CHUNK_EVIDENCE_SQL = """chunk_facts AS (SELECT c.case_id, chunk_id, stored_file_path AS file_path, c.document_id, confidence_code FROM chunks c JOIN case_documents d USING (document_id) WHERE ingestion_status <> 'failed')"""


@query("evidence_resolve", f"""WITH {CASE_DOCUMENTS_SQL}, {DOCUMENT_CHUNKS_SQL}, {CHUNK_EVIDENCE_SQL} SELECT case_id, 'chunk' AS owner_kind, chunk_id AS owner_key, file_path, chunk_id AS reference_id, document_id, confidence_code FROM chunk_facts""")
def evidence_resolve(spark, sf):
    return ev.record_evidence(chunk_records(spark, sf), case_documents(spark, sf), present_files(spark, sf))


def paired_records(spark, sf):
    """Every document's entity points to the first chunk of the document and of its successor."""
    docs = case_documents(spark, sf).select("case_id", "document_id", "created_ord")
    return with_next(docs, ["case_id"], ["created_ord"], "document_id", "n").selectExpr(
        "case_id", "'entity' as owner_kind", "'E' || document_id as owner_key", "document_id || '-0<SEP>UNKNOWN<SEP>' || coalesce(n || '-0', '') as source_id")


@query("evidence_by_chunk", f"""WITH {CASE_DOCUMENTS_SQL}, {DOCUMENT_CHUNKS_SQL}, {CHUNK_EVIDENCE_SQL}, p AS (SELECT case_id, document_id, lead(document_id) OVER (PARTITION BY case_id ORDER BY created_ord) AS n FROM case_documents),
t AS (SELECT case_id, document_id, document_id || '-0' AS chunk_id FROM p UNION ALL SELECT case_id, document_id, n || '-0' FROM p WHERE n IS NOT NULL)
SELECT t.case_id, 'entity' AS owner_kind, 'E' || t.document_id AS owner_key, file_path, f.chunk_id AS reference_id, f.document_id, confidence_code FROM t JOIN chunk_facts f ON f.case_id = t.case_id AND f.chunk_id = t.chunk_id""")
def evidence_by_chunk(spark, sf):
    return ev.evidence_by_chunk(paired_records(spark, sf), evidence_resolve(spark, sf))


@query("evidence_mapping", f"""WITH {CASE_DOCUMENTS_SQL}, here AS (SELECT * FROM case_documents WHERE ingestion_status <> 'failed')
SELECT case_id, 'entity' AS owner_kind, unnest([lang, confidence_code]) AS owner_key, stored_file_path AS file_path, document_id AS reference_id, document_id, confidence_code FROM here
UNION ALL SELECT case_id, 'pair', lang || '|' || confidence_code, stored_file_path, document_id, document_id, confidence_code FROM here""")
def evidence_mapping(spark, sf):
    docs = case_documents(spark, sf)
    names = docs.select("case_id", "document_id", F.array(F.concat(F.lit(" "), "tags"), F.col("confidence_code"), F.lit(" "), F.col("tags")).alias("entity_names"))
    pairs = docs.select("case_id", "document_id", F.array(F.array("tags", "confidence_code"), F.array(F.col("tags")), F.array("tags", F.lit(""))).alias("relation_pairs"))
    return ev.mapping_evidence(names, pairs, docs, present_files(spark, sf))


@query("chunk_texts", f"""WITH {CASE_DOCUMENTS_SQL}, {DOCUMENT_CHUNKS_SQL}, {CHUNK_EVIDENCE_SQL} SELECT case_id, chunk_id AS key, content FROM chunks WHERE content <> ''
UNION ALL SELECT case_id, 'alias-' || chunk_id, content FROM chunks JOIN (SELECT chunk_id FROM chunk_facts) USING (chunk_id) WHERE content <> ''""")
def chunk_texts(spark, sf):
    chunks = document_chunks(spark, sf).withColumn("alias", F.concat(F.lit("alias-"), "chunk_id"))
    return ev.chunk_texts(chunks, evidence_resolve(spark, sf))
