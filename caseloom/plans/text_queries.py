"""Vocabulary, naming and text-preparation queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import text as tx, vocabulary as voc
from caseloom.operators import naming, textprep as tp
from caseloom.plans.bindings import (
    CASE_DOCUMENTS_SQL, CONTENT_BLOCKS_SQL, DOCUMENT_CHUNKS_SQL, NONE, case_documents, content_blocks, document_chunks, table,
)
from caseloom.session import with_next

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)


EVENT_WORDING = """CASE event_type WHEN 'view' THEN 'witnessed | seen at' WHEN 'click' THEN 'Contacted, emailed; owner of' WHEN 'purchase' THEN 'purchased'
WHEN 'signup' THEN ' Member of ' ELSE 'nothing known' END"""
EVENT_LABEL = "CASE WHEN event_id % 3 = 0 THEN 'paid to' WHEN event_id % 3 = 1 THEN '' ELSE NULL END"


@query("relation_normalise", f"""WITH vocabulary(word, relation) AS ({_values(sorted(voc.relation_vocabulary().items()))}),
said AS (SELECT event_id, 0 AS pos, trim({EVENT_WORDING}) AS t FROM events UNION ALL SELECT event_id, 1, trim({EVENT_LABEL}) FROM events),
texts AS (SELECT event_id, pos, t, list_filter(regexp_split_to_array(trim(translate(lower(t), ',|;', '   ')), '\\s+'), lambda x: x <> '') AS w FROM said WHERE t <> ''),
tokens AS (SELECT event_id, pos, 0 AS i, array_to_string(w, '_') AS token FROM texts WHERE len(w) > 0
  UNION ALL SELECT event_id, pos, i, token FROM (SELECT event_id, pos, w, generate_subscripts(w, 1) AS i, unnest(w) AS token FROM texts) WHERE token <> array_to_string(w, '_')),
counted AS (SELECT event_id, relation, count(*) AS n, min(pos * 1000 + i) AS first FROM tokens JOIN vocabulary ON word = token GROUP BY 1, 2),
best AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) = 1),
scored AS (SELECT e.event_id, coalesce(relation, 'ASSOCIATED_WITH') AS relation_type, (SELECT arg_min(t, pos) FROM texts x WHERE x.event_id = e.event_id) AS raw_phrase,
 CASE WHEN n > 1 THEN 0.82 WHEN n = 1 THEN 0.72 WHEN EXISTS (SELECT 1 FROM texts x WHERE x.event_id = e.event_id) THEN 0.48 ELSE 0.4 END AS confidence_score
 FROM events e LEFT JOIN best b ON b.event_id = e.event_id)
SELECT *, CASE WHEN confidence_score >= 0.75 THEN 'high' WHEN confidence_score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence_band FROM scored""")
def relation_normalise(spark, sf):
    texts = F.array(F.expr(EVENT_WORDING), F.expr(EVENT_LABEL))
    return table(spark, sf, "events").select("event_id", voc.normalise_relation(texts).alias("r")).select("event_id", "r.*")


RAW_TYPE = """CASE p_partkey % 7 WHEN 0 THEN 'Company' WHEN 1 THEN ' phone ' WHEN 2 THEN 'Person' WHEN 3 THEN 'email' WHEN 4 THEN 'City' WHEN 5 THEN lower(p_type) ELSE NULL END"""


@query("entity_type_normalise", f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'organization' WHEN 2 THEN 'person' WHEN 3 THEN 'event' WHEN 4 THEN 'location' ELSE 'object' END AS entity_type,
CASE p_partkey % 7 WHEN 1 THEN 'device' WHEN 3 THEN 'communication' END AS entity_subtype,
CASE WHEN p_size % 3 = 0 THEN 'organization' END AS prefix_type, p_name AS bare_label FROM part""")
def entity_type_normalise(spark, sf):
    label = F.expr("case when p_size % 3 = 0 then '[Organization]  ' || p_name else p_name end")
    return table(spark, sf, "part").withColumn("raw", F.expr(RAW_TYPE)).select(
        "p_partkey", voc.normalise_entity_type(F.col("raw")).alias("entity_type"), voc.entity_subtype(F.col("raw")).alias("entity_subtype"),
        tx.prefixed_type(label).alias("prefix_type"), tx.without_type(label).alias("bare_label"))


@query("confidence_codes", """SELECT doc_id, CASE WHEN quality IN (0, 1) AND toxic + 1 BETWEEN 1 AND 4 AND doc_id % 5 <> 0 THEN CASE WHEN quality = 1 THEN 'A' ELSE 'C' END || (toxic + 1) END AS code FROM labels""")
def confidence_codes(spark, sf):
    letter = F.expr("case when doc_id % 5 = 0 then 'd' when quality = 1 then ' a' else 'c ' end")
    return table(spark, sf, "labels").select("doc_id", voc.confidence_code(letter, F.col("toxic") + 1).alias("code"))


@query("date_extract", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN '1999-01-02' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS found FROM orders
WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0""")
def date_extract(spark, sf):
    text = F.expr("""case when o_orderkey % 7 = 0 then 'no date, 12345-01-01, 13/45/2001' when o_orderkey % 5 = 0 then 'on ' || date_format(o_orderdate, 'yyyy-MM-dd') || '.'
      when o_orderkey % 5 = 1 then 'seen ' || date_format(o_orderdate, 'yyyy/MM/dd') || ' twice' when o_orderkey % 5 = 2 then date_format(o_orderdate, 'M/d/yyyy') || ' noon'
      when o_orderkey % 5 = 3 then 'by ' || date_format(o_orderdate, 'M-d-yy') else '2024-13-45 then 1/2/99' end""")
    return table(spark, sf, "orders").select("o_orderkey", tx.first_date(text).alias("found"))


@query("label_clean", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' is big' WHEN 1 THEN 'the ' || p_name || ' is big' WHEN 2 THEN 'A ' || p_name || ' is here'
WHEN 3 THEN p_name || ' - ' || p_name || 'ish' WHEN 4 THEN p_name || ': ' || p_name || chr(10) || 'more' ELSE 'about ' || p_name END AS cleaned FROM part""")
def label_clean(spark, sf):
    description = F.expr("""case p_partkey % 6 when 0 then ' ' || upper(p_name) || ': ' || p_name || ' is big ' when 1 then p_name || ' - the ' || p_name || ' is big'
      when 2 then 'The ' || p_name || ', A ' || p_name || ' is here' when 3 then p_name || ' - ' || p_name || 'ish'
      when 4 then p_name || ': ' || p_name || '\n' || 'more' else 'about ' || p_name end""")
    return table(spark, sf, "part").select("p_partkey", tx.clean_description(description, F.col("p_name")).alias("cleaned"))


@query("text_key", """SELECT page_id, trim(regexp_replace(lower(replace(url, '_', ' ')), '[^a-z0-9]+', ' ', 'g')) AS url_key,
trim(regexp_replace(lower(regexp_extract(url, '([^/]*)/*$', 1)), '[^a-z0-9]+', ' ', 'g')) AS file_key FROM pages""")
def text_key(spark, sf):
    tagged, stored = F.concat(F.lit(" [PERSON] "), "url"), F.expr("'/store/0f8fad5b-d9cb-469f-a165-70867728950e_' || regexp_extract(url, '([^/]*)/*$', 1)")
    return table(spark, sf, "pages").select("page_id", tx.text_key(tagged).alias("url_key"), tx.file_key(stored).alias("file_key"))


@query("clip_texts", r"""SELECT conv_id, turn, CASE WHEN length(s) > 72 THEN rtrim(left(s, 69)) || '...' ELSE s END AS chat_title, CASE WHEN length(s) > 220 THEN rtrim(left(s, 217)) || '...' ELSE s END AS snippet,
CASE WHEN lower(left(text, 2)) IN ('na', 'no') THEN NULL ELSE CASE WHEN length(trim(text)) > 500 THEN rtrim(left(trim(text), 497), ' ' || chr(10)) || '...' ELSE trim(text) END END AS fact
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations)""")
def clip_texts(spark, sf):
    squeezed = tx.squeeze(F.col("text"))
    fact = F.expr("case when lower(left(text, 2)) = 'na' then ' N/A ' when lower(left(text, 2)) = 'no' then 'Not available' else text end")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.clip(squeezed, 72).alias("chat_title"), tx.clip(squeezed, 220).alias("snippet"), tx.fact_value(fact).alias("fact"))


@query("first_json", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3""")
def first_json(spark, sf):
    reply = F.expr("""case event_id % 4 when 0 then props when 1 then 'Here it is:\n```json\n' || props || '\n``` Done.' when 2 then 'Answer ' || props || ' as asked' else 'none {broken' end""")
    body = tx.first_json_object(reply)
    return table(spark, sf, "events").select("event_id", body.alias("j")).select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"))


@query("descriptive_names", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Meeting about ' || p_name WHEN 1 THEN 'The ' || p_name WHEN 2 THEN upper(p_name[1]) || p_name[2:] END AS name FROM part""")
def descriptive_names(spark, sf):
    kind = F.expr("case p_partkey % 4 when 0 then 'Event' when 1 then 'document' when 2 then 'asset' else 'person' end")
    text = F.expr("""case p_partkey % 4 when 0 then 'event_12<SEP>the meeting about ' || p_name || '. ' when 1 then ' document \n The  ' || p_name || ';' else 'Asset<SEP>a ' || p_name end""")
    return table(spark, sf, "part").select("p_partkey", tx.descriptive_name(kind, text).alias("name"))


@query("unique_slugs", """WITH req AS (SELECT p_partkey AS ord, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ord) AS k FROM req) SELECT ord, slug, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS unique_slug FROM n""")
def unique_slugs(spark, sf):
    requests = table(spark, sf, "part").select(tx.slug(F.col("p_name")).alias("slug"), F.col("p_partkey").alias("ord"))
    return naming.allocate_slugs(requests, requests.filter("ord < 0").select("slug"))


@query("unique_slugs_reserved", """WITH req AS (SELECT p_partkey AS ord, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, p_size FROM part),
base AS (SELECT DISTINCT slug FROM req WHERE p_size % 7 = 3), held AS (SELECT DISTINCT slug, 2 + p_size % 4 AS number FROM req WHERE p_size % 5 = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY number) AS t FROM held),
n AS (SELECT r.*, row_number() OVER (PARTITION BY r.slug ORDER BY ord) - CASE WHEN b.slug IS NULL THEN 1 ELSE 0 END AS j FROM req r LEFT JOIN base b USING (slug))
SELECT ord, slug, CASE WHEN j = 0 THEN slug ELSE slug || '-' || (1 + j + (SELECT count(*) FROM ranked b WHERE b.slug = n.slug AND number - 1 - t < j)) END AS unique_slug FROM n""")
def unique_slugs_reserved(spark, sf):
    """Some slugs and some numbered ones are taken before the first request."""
    part = table(spark, sf, "part").withColumn("slug", tx.slug(F.col("p_name")))
    taken = part.filter("p_size % 7 = 3").select("slug").unionByName(part.filter("p_size % 5 = 1").selectExpr("concat(slug, '-', 2 + p_size % 4) as slug")).distinct()
    return naming.allocate_slugs(part.select("slug", F.col("p_partkey").alias("ord")), taken)


@query("unique_names", """WITH req AS (SELECT p_partkey AS ord, p_name AS name, lower(p_type) AS kind FROM part),
reserved AS (SELECT DISTINCT p_name AS name, lower(p_type) AS kind, 2 + p_size % 4 AS number FROM part WHERE p_size % 5 = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY number) AS t FROM reserved),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS k FROM req),
rest AS (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY ord) AS j FROM n WHERE k > 1)
SELECT ord, name, name AS unique_name FROM n WHERE k = 1 UNION ALL
SELECT ord, name, name || ' (' || kind || ' ' || (1 + j + (SELECT count(*) FROM ranked b WHERE b.name = r.name AND b.kind = r.kind AND number - 1 - t < j)) || ')' FROM rest r""")
def unique_names(spark, sf):
    part = table(spark, sf, "part")
    requests = part.selectExpr("p_name as name", "p_type as type", "p_partkey as ord")
    reserved = part.filter("p_size % 5 = 1").selectExpr("p_name || ' (' || lower(p_type) || ' ' || (2 + p_size % 4) || ')' as name").distinct()
    return naming.allocate_names(requests, reserved)


# --- files and routes ----------------------------------------------------------------------------

def evidence_files(spark, sf):
    """Documents, web pages and event payloads as evidence files."""
    docs = table(spark, sf, "documents").selectExpr("source as case_id", "'D' || doc_id as document_id", "doc_id || '.md' as file_name", "'' as mime_type", "'full_enrichment' as profile", "text as content")
    pages = table(spark, sf, "pages").selectExpr("'web' as case_id", "'W' || page_id as document_id", "page_id || '.HTML' as file_name", "'application/xhtml' as mime_type", "'balanced_fast_intel' as profile", "html as content")
    payloads = table(spark, sf, "events").selectExpr("'log' as case_id", "'E' || event_id as document_id", "event_id || '.json' as file_name", "'application/json' as mime_type", f"{NONE} as profile",
                                                     "case when event_id % 3 = 0 then '[' || props || ', []]' when event_id % 3 = 1 then props else '{broken' end as content")
    return docs.unionByName(pages).unionByName(payloads)


FILES_SQL = """files AS (SELECT source AS case_id, 'D' || doc_id AS document_id, 'text' AS source_kind, text AS content, CAST(NULL AS BIGINT) AS json_depth, trunc(90 * 0.7::DOUBLE) * 1.6::DOUBLE AS eta FROM documents
UNION ALL SELECT 'web', 'W' || page_id, 'html', html, NULL, trunc(90 * 0.7::DOUBLE) * 1.2::DOUBLE FROM pages
UNION ALL SELECT 'log', 'E' || event_id, 'structured', CASE WHEN event_id % 3 = 0 THEN '[' || props || ', []]' WHEN event_id % 3 = 1 THEN props ELSE '{broken' END, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 END, trunc(90 * 0.85::DOUBLE) FROM events)"""


@query("preflight", f"""WITH {FILES_SQL} SELECT case_id, document_id, source_kind, strlen(content) AS size_bytes, round(strlen(content) / 1048576.0, 3) AS size_mb,
CASE WHEN strlen(content) = 0 THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END AS line_count, json_depth, 'small' AS complexity_class,
greatest(45, CAST(trunc(eta) AS BIGINT)) AS eta_seconds, false AS slow_warning, false AS archive_warning FROM files""")
def preflight(spark, sf):
    return tp.preflight(evidence_files(spark, sf))


@query("source_kind", """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'text' WHEN 3 THEN 'structured' WHEN 4 THEN 'html' WHEN 5 THEN 'email' WHEN 6 THEN 'archive' WHEN 7 THEN 'office_document' ELSE 'generic' END AS source_kind,
CASE p_partkey % 9 WHEN 0 THEN CASE WHEN p_size <= 20 THEN 'small' WHEN p_size <= 80 THEN 'medium' WHEN p_size <= 220 THEN 'large' ELSE 'very_large' END
 WHEN 6 THEN CASE WHEN p_size * 20 <= 20 THEN 'small' WHEN p_size * 20 <= 120 THEN 'medium' WHEN p_size * 20 <= 500 THEN 'large' ELSE 'very_large' END
 WHEN 1 THEN CASE WHEN p_size <= 3 THEN 'small' WHEN p_size <= 10 THEN 'medium' WHEN p_size <= 30 THEN 'large' ELSE 'very_large' END
 WHEN 2 THEN CASE WHEN p_size <= 4 THEN CASE WHEN p_size <= 0.8 THEN 'small' ELSE 'medium' END WHEN p_size <= 20 THEN 'large' ELSE 'very_large' END
 WHEN 3 THEN CASE WHEN p_size <= 4 THEN CASE WHEN p_size <= 0.8 THEN 'small' ELSE 'medium' END WHEN p_size <= 20 THEN 'large' ELSE 'very_large' END
 WHEN 4 THEN CASE WHEN p_size <= 4 THEN CASE WHEN p_size <= 0.8 THEN 'small' ELSE 'medium' END WHEN p_size <= 20 THEN 'large' ELSE 'very_large' END
 ELSE CASE WHEN p_size <= 2 THEN 'small' WHEN p_size <= 15 THEN 'medium' WHEN p_size <= 45 THEN 'large' ELSE 'very_large' END END AS complexity_class FROM part""")
def source_kind(spark, sf):
    name = F.expr("""p_name || case p_partkey % 9 when 0 then '.PDF' when 1 then '' when 2 then '' when 3 then '.csv' when 4 then '.htm' when 5 then '.eml' when 6 then '.zip' when 7 then '.docx' else '.bin' end""")
    mime = F.expr("case p_partkey % 9 when 1 then 'image/png' when 2 then 'text/csv' when 3 then 'application/csv' else 'application/octet-stream' end")
    kind = tp.source_kind(name, mime)
    return table(spark, sf, "part").withColumn("source_kind", kind).select(
        "p_partkey", "source_kind", tp.complexity_class(F.col("source_kind"), F.col("p_size").cast("double"), F.col("p_size"), F.col("p_size") * 20).alias("complexity_class"))


@query("route", """WITH r AS (SELECT p_partkey, p_size, ['text', 'image', 'pdf', 'email', 'audio', 'archive', 'generic'][1 + p_partkey % 7] AS kind, ['', 'OCR', 'txt', 'auto', 'other'][1 + p_size % 5] AS f,
 ['', 'off', 'auto', 'force'][1 + (p_partkey // 7) % 4] AS o, CASE WHEN p_partkey % 2 = 0 THEN 'full_enrichment' ELSE 'balanced_fast_intel' END AS profile FROM part),
s AS (SELECT *, lower(f) AS forced, lower(f) IN ('txt', 'ocr', 'auto') AS named, CASE WHEN o <> '' THEN o WHEN profile = 'full_enrichment' THEN 'auto' ELSE 'off' END AS ocr FROM r),
m AS (SELECT *, CASE kind WHEN 'text' THEN CASE WHEN forced = 'ocr' THEN 'ocr' ELSE 'txt-direct' END
 WHEN 'image' THEN CASE WHEN named THEN CASE WHEN forced = 'txt' THEN 'auto' ELSE forced END WHEN ocr IN ('force', 'auto') THEN 'ocr' ELSE 'auto' END
 WHEN 'pdf' THEN CASE WHEN named THEN forced WHEN ocr = 'force' THEN 'ocr' WHEN ocr = 'off' THEN 'txt' WHEN profile = 'full_enrichment' THEN 'auto' WHEN p_size * 4 >= 80 THEN 'txt' ELSE 'ocr' END
 WHEN 'audio' THEN 'auto' WHEN 'archive' THEN 'auto' ELSE CASE WHEN named THEN forced ELSE 'auto' END END AS parse_method FROM s)
SELECT p_partkey, CASE kind WHEN 'text' THEN CASE WHEN forced = 'ocr' THEN 'text_parse' ELSE 'text_direct' END WHEN 'audio' THEN 'media_audio' WHEN 'archive' THEN 'archive_auto'
 WHEN 'generic' THEN 'generic_parse' ELSE kind || '_' || parse_method END AS route_type, parse_method FROM m""")
def route(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_size", "array('text', 'image', 'pdf', 'email', 'audio', 'archive', 'generic')[p_partkey % 7] as kind", "array('', 'OCR', 'txt', 'auto', 'other')[p_size % 5] as f",
        "array('', 'off', 'auto', 'force')[(p_partkey div 7) % 4] as o", "case when p_partkey % 2 = 0 then 'full_enrichment' else 'balanced_fast_intel' end as profile")
    return rows.select("p_partkey", tp.route(F.col("kind"), F.col("profile"), F.col("f"), F.col("o"), (F.col("p_size") * 4).cast("double")).alias("r")).select("p_partkey", "r.*")


# --- blocks and chunks ---------------------------------------------------------------------------

@query("content_types", f"WITH {CONTENT_BLOCKS_SQL} SELECT case_id, document_id, type, count(*) AS count FROM block_texts GROUP BY 1, 2, 3")
def content_types(spark, sf):
    return tp.content_type_counts(content_blocks(spark, sf))


@query("block_texts", f"WITH {CONTENT_BLOCKS_SQL} SELECT case_id, document_id, block_no, body FROM block_texts WHERE body IS NOT NULL")
def block_texts(spark, sf):
    return tp.block_text(content_blocks(spark, sf)).select("case_id", "document_id", F.col("block_no").cast("long").alias("block_no"), "body")


@query("compose_text", f"""WITH {CONTENT_BLOCKS_SQL}, firsts AS (SELECT case_id, document_id, lower(body) AS k, arg_min(body, block_no) AS body, min(block_no) AS block_no FROM block_texts WHERE body IS NOT NULL GROUP BY 1, 2, 3)
SELECT case_id, document_id, string_agg(body, chr(10) || chr(10) ORDER BY block_no) AS text FROM firsts GROUP BY 1, 2""")
def compose_text(spark, sf):
    return tp.compose_text(content_blocks(spark, sf))


@query("char_budget", f"""WITH {CONTENT_BLOCKS_SQL}, used AS (SELECT *, 24000 - coalesce(sum(length(body)) OVER (PARTITION BY document_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
FROM block_texts WHERE body IS NOT NULL) SELECT case_id, document_id, block_no, left(body, remaining::BIGINT) AS body FROM used WHERE remaining > 0""")
def char_budget(spark, sf):
    return tp.char_budget(content_blocks(spark, sf)).withColumn("block_no", F.col("block_no").cast("long"))


@query("rough_tokens", r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tokens FROM documents""")
def rough_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.rough_tokens(F.col("text")).cast("long").alias("tokens"))


@query("boundaries", f"""WITH {CONTENT_BLOCKS_SQL} SELECT case_id, document_id, block_no, (starts_with(t, 'Image:') OR starts_with(t, 'Table:') OR starts_with(t, 'Equation:') OR starts_with(t, 'Page ')
OR (length(t) <= 90 AND t[-1] NOT IN ('.', '?', '!', ':', ';'))) AS boundary FROM (SELECT *, trim(body) AS t FROM block_texts WHERE body IS NOT NULL)""")
def boundaries(spark, sf):
    return tp.block_text(content_blocks(spark, sf)).select(
        "case_id", "document_id", F.col("block_no").cast("long").alias("block_no"), tp.is_boundary(F.col("body")).alias("boundary"))


@query("coalesce_blocks", rf"""WITH RECURSIVE {CONTENT_BLOCKS_SQL}, sized AS (SELECT case_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY block_no) AS n, t,
 greatest(1, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))) AS tokens, (starts_with(t, 'Image:') OR starts_with(t, 'Table:') OR starts_with(t, 'Equation:') OR starts_with(t, 'Page ')
 OR (length(t) <= 90 AND t[-1] NOT IN ('.', '?', '!', ':', ';'))) AS alone FROM (SELECT *, trim(body) AS t FROM block_texts WHERE body IS NOT NULL) WHERE t <> ''),
fold AS (SELECT document_id, n, 0::BIGINT AS window_no, CASE WHEN alone OR tokens >= 500 THEN 1 ELSE 0 END::BIGINT AS open, CASE WHEN alone OR tokens >= 500 THEN 0 ELSE tokens END::BIGINT AS held FROM sized WHERE n = 1
UNION ALL SELECT s.document_id, s.n, CASE WHEN f.held > 0 AND (s.alone OR f.held + s.tokens > 600) THEN f.open + 1 ELSE f.open END,
 CASE WHEN f.held > 0 AND (s.alone OR f.held + s.tokens > 600) THEN f.open + 1 ELSE f.open END + CASE WHEN s.alone OR CASE WHEN f.held + s.tokens > 600 THEN 0 ELSE f.held END + s.tokens >= 500 THEN 1 ELSE 0 END,
 CASE WHEN s.alone OR CASE WHEN f.held + s.tokens > 600 THEN 0 ELSE f.held END + s.tokens >= 500 THEN 0 ELSE CASE WHEN f.held + s.tokens > 600 THEN 0 ELSE f.held END + s.tokens END
 FROM fold f JOIN sized s ON s.document_id = f.document_id AND s.n = f.n + 1)
SELECT s.case_id, s.document_id, window_no, trim(string_agg(t, chr(10) ORDER BY s.n)) AS text FROM sized s JOIN fold f ON f.document_id = s.document_id AND f.n = s.n GROUP BY 1, 2, 3""")
def coalesce_blocks(spark, sf):
    blocks = tp.block_text(content_blocks(spark, sf)).select("case_id", "document_id", "block_no", F.col("body").alias("text"))
    return tp.coalesce_blocks(blocks)


@query("char_chunks", r"""WITH RECURSIVE cuts AS (SELECT doc_id, 0 AS chunk_no, 0::BIGINT AS s, 0::BIGINT AS e FROM documents WHERE false
UNION ALL SELECT doc_id, 0, 0, CASE WHEN length(text) <= 4000 THEN length(text) WHEN strpos(reverse(text[2001:4000]), ' ') > 0 THEN 4000 - strpos(reverse(text[2001:4000]), ' ') ELSE 4000 END FROM documents WHERE length(text) > 0),
chain AS (SELECT * FROM cuts UNION ALL SELECT c.doc_id, chunk_no + 1, greatest(c.e - 400, c.s + 1),
 CASE WHEN length(text) <= greatest(c.e - 400, c.s + 1) + 4000 THEN length(text)
  WHEN strpos(reverse(text[greatest(c.e - 400, c.s + 1) + 2001:greatest(c.e - 400, c.s + 1) + 4000]), ' ') > 0
  THEN greatest(c.e - 400, c.s + 1) + 4000 - strpos(reverse(text[greatest(c.e - 400, c.s + 1) + 2001:greatest(c.e - 400, c.s + 1) + 4000]), ' ')
  ELSE greatest(c.e - 400, c.s + 1) + 4000 END
 FROM chain c JOIN documents d ON d.doc_id = c.doc_id WHERE c.e < length(text))
SELECT source AS case_id, 'D' || doc_id AS document_id, chunk_no, trim(text[s + 1:e], ' ' || chr(10) || chr(9) || chr(13)) AS content FROM chain JOIN documents USING (doc_id)""")
def char_chunks(spark, sf):
    return tp.char_chunks(case_documents(spark, sf).select("case_id", "document_id", "text"))


@query("token_chunks", f"WITH {DOCUMENT_CHUNKS_SQL} SELECT * FROM chunks")
def token_chunks(spark, sf):
    return document_chunks(spark, sf)


@query("notes_provenance", f"""WITH {CONTENT_BLOCKS_SQL}, {CASE_DOCUMENTS_SQL} SELECT b.case_id, b.document_id, block_no, type, CASE WHEN block_no % 5 IN (0, 2, 4) THEN line END AS text, confidence_code
FROM (SELECT * FROM block_lines JOIN block_texts USING (case_id, document_id, block_no)) b JOIN case_documents d ON d.document_id = b.document_id
UNION ALL SELECT case_id, document_id, -1, 'text', 'Analyst notes for this evidence:' || chr(10) || 'Language ' || lang, confidence_code FROM case_documents WHERE lang <> 'en'""")
def notes_provenance(spark, sf):
    documents = case_documents(spark, sf).withColumn("notes", F.expr("case when tags = 'en' then ' ' else ' Language ' || tags end"))
    out = tp.with_notes_and_provenance(content_blocks(spark, sf), documents)
    return out.withColumn("type", F.lower("type")).withColumn("block_no", F.col("block_no").cast("long"))


@query("annotate", f"""WITH {CASE_DOCUMENTS_SQL}, {DOCUMENT_CHUNKS_SQL}, recs AS (SELECT case_id, 'V' || doc_id AS record_id, lead(document_id) OVER (PARTITION BY case_id ORDER BY created_ord) AS next_doc, document_id, created_ord FROM case_documents),
tok AS (SELECT case_id, record_id, document_id || '-0' AS chunk_id FROM recs UNION ALL SELECT case_id, record_id, next_doc || '-0' FROM recs WHERE next_doc IS NOT NULL),
hit AS (SELECT t.case_id, record_id, arg_max(d.document_id, created_ord) AS document_id, arg_max(confidence_code, created_ord) AS confidence_code, arg_min(stored_file_path, created_ord) AS file_path
 FROM tok t JOIN chunks c ON c.case_id = t.case_id AND c.chunk_id = t.chunk_id JOIN case_documents d ON d.document_id = c.document_id GROUP BY 1, 2)
SELECT r.case_id, r.record_id, r.document_id || '-0' || coalesce('<SEP>' || next_doc || '-0', '') AS source_id, h.document_id, h.confidence_code, h.file_path FROM recs r LEFT JOIN hit h ON h.case_id = r.case_id AND h.record_id = r.record_id""")
def annotate(spark, sf):
    docs = case_documents(spark, sf)
    paired = with_next(docs.select("case_id", "document_id", "created_ord"), ["case_id"], ["created_ord"], "document_id", "n")
    records = paired.select("case_id", F.expr("'V' || substr(document_id, 2)").alias("record_id"), F.lit(None).cast("string").alias("file_path"),
                            F.concat(F.col("document_id"), F.lit("-0"), F.coalesce(F.concat(F.lit("<SEP>"), "n", F.lit("-0")), F.lit(""))).alias("source_id"))
    chunks = document_chunks(spark, sf).select("case_id", "chunk_id", F.lit(None).cast("string").alias("alias"), "document_id")
    return tp.annotate_by_chunks(records, chunks, docs.select("case_id", "document_id", "confidence_code", "stored_file_path", F.col("created_ord").alias("ingest_order")))


@query("document_counts", """SELECT 'case' AS case_id, 'D' || o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE n END AS entities, n AS relations
FROM (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)""")
def document_counts(spark, sf):
    lists = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("names"))
    key = [F.lit("case").alias("case_id"), F.concat(F.lit("D"), "l_orderkey").alias("document_id")]
    entities = lists.select(*key, F.col("names").alias("entity_names"), F.when(F.col("l_orderkey") % 2 == 0, 7).alias("count"))
    relations = lists.select(*key, F.transform("names", lambda n: F.array(n, n)).alias("relation_pairs"), F.lit(None).cast("int").alias("count"))
    return tp.document_graph_counts(entities, relations)


@query("infer_triples", r"""WITH parts AS (SELECT source AS case_id, doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)),
tok AS (SELECT case_id, list_filter(list_transform(string_split(line, ','), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' "''`.;:' || chr(9) || chr(10) || chr(13))), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')) AS t FROM parts WHERE contains(line, ',')),
rel AS (SELECT case_id, t[1] AS src_id, t[-1] AS tgt_id, upper(trim(regexp_replace(array_to_string(t[2:-2], ' '), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS p FROM tok WHERE len(t) >= 3),
typed AS (SELECT *, CASE WHEN contains(p, 'SHAREHOLDER') OR contains(p, 'MEMBER') THEN 'MEMBER_OF' WHEN contains(p, 'OWNER') OR contains(p, 'OWNS') THEN 'OWNS' WHEN p = '' THEN 'RELATED_TO' ELSE p END AS type FROM rel)
SELECT DISTINCT case_id, src_id, type, tgt_id, src_id || '__' || type || '__' || tgt_id AS relation_id FROM typed""")
def infer_triples(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("source").alias("case_id"), F.explode(F.split("text", "\n")).alias("text"))
    return tp.infer_triples(lines)


@query("inferred_entities", ORACLE["infer_triples"].replace("SELECT DISTINCT case_id, src_id, type, tgt_id, src_id || '__' || type || '__' || tgt_id AS relation_id FROM typed", "SELECT DISTINCT case_id, unnest([src_id, tgt_id]) AS entity_id FROM typed"))
def inferred_entities(spark, sf):
    return tp.inferred_entities(infer_triples(spark, sf))
