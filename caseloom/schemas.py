"""Schemas of the metadata tables and of the file-shaped inputs."""

from __future__ import annotations

TABLES = {
    "case": "id string, name string, description string, status string, case_slug string, created_at timestamp, updated_at timestamp",
    "case_summary_cache": "case_id string, summary_json string, source_document_count long, source_completed_job_id string, last_refreshed_at timestamp",
    "document": """id string, case_id string, original_filename string, stored_file_path string, content_hash_sha256 string, mime_type string,
        size_bytes long, confidence_source_reliability string, confidence_information_validity string, confidence_code string, tags string,
        notes string, ingest_model_name string, ingestion_status string, ingestion_error string, created_at timestamp, updated_at timestamp""",
    "chat": "id string, case_id string, title string, created_at timestamp, updated_at timestamp",
    "message": "id string, chat_id string, role string, content string, created_at timestamp, rag_metadata_json string",
    "ingestion_job": """id string, case_id string, document_id string, ingest_profile string, processing_mode string, advanced_overrides_json string,
        preflight_json string, complexity_class string, eta_seconds long, queue_priority string, route_type string, status string, progress long,
        started_at timestamp, finished_at timestamp, parse_seconds double, insert_seconds double, total_seconds double, current_stage string, error string""",
    "ingestion_job_log": "id long, job_id string, case_id string, created_at timestamp, level string, message string",
    "llm_call_trace": """id string, job_id string, case_id string, stage string, model string, provider string, request_summary string,
        latency_ms double, prompt_tokens long, completion_tokens long, total_tokens long, error string, created_at timestamp""",
}

KV_RECORDS = {
    "text_chunks": "_id string, reference_id string, document_id string, full_doc_id string, confidence_code string, file_path string, content string, tokens long",
    "full_docs": "content string, file_path string",
    "doc_status": "status string, chunks_count long, chunks_list array<string>, content_summary string, content_length long, created_at string, updated_at string, file_path string, track_id string",
    "full_entities": "entity_names array<string>, count long, create_time long",
    "full_relations": "relation_pairs array<array<string>>, count long",
    "entity_chunks": "chunk_ids array<string>, count long",
    "relation_chunks": "chunk_ids array<string>, count long",
}

VECTOR_RECORD = """__id__ string, id string, __vector__ array<float>, full_doc_id string, document_id string, source_id string, file_path string,
    entity_name string, entity_type string, src_id string, tgt_id string, content string"""

LINK_NODE = "node_id string, name string, countries string, country_codes string, sourceID string, valid_until string, note string"
LINK = "node_id_start string, node_id_end string, rel_type string, link string, status string, start_date string, end_date string, sourceID string"
