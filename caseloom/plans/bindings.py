"""How the given tables become a case model, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.operators.consolidate import edge_id, end_counts
from caseloom.session import cut_lineage

NONE = "cast(null as string)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _places(spark, sf):
    return table(spark, sf, "nation").select(
        F.concat(F.lit("case-"), F.col("n_regionkey").cast("string")).alias("case_id"), "n_nationkey", "n_name", "n_regionkey"
    )


def trade_node_records(spark: SparkSession, sf: str) -> DataFrame:
    """Raw node records: customers, suppliers, places and orders of each region's case (parts stay implicit)."""
    nation = _places(spark, sf)
    cust = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = [
        cust.selectExpr("case_id", "'C:' || c_custkey as entity_name", "c_name as label", "'person' as entity_type",
                        "c_mktsegment || ' customer' as description", "c_custkey as row_ord"),
        table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
            "case_id", "'S:' || s_suppkey as entity_name", "s_name as label", "'company' as entity_type",
            f"{NONE} as description", "s_suppkey as row_ord"),
        nation.selectExpr("case_id", "'N:' || n_nationkey as entity_name", "n_name as label", "'country' as entity_type",
                          f"{NONE} as description", "cast(n_nationkey as long) as row_ord"),
        table(spark, sf, "region").selectExpr("'case-' || r_regionkey as case_id", "'R:' || r_regionkey as entity_name",
                                              "r_name as label", "'region' as entity_type", f"{NONE} as description",
                                              "cast(r_regionkey as long) as row_ord"),
        table(spark, sf, "orders").join(cust.select("c_custkey", "case_id"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
            "case_id", "'O:' || o_orderkey as entity_name", "'Order ' || o_orderkey as label", "'transaction' as entity_type",
            "o_orderpriority || ' order' as description", "o_orderkey as row_ord"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("source_ord", F.lit(0))


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """One row per edge of the trade graph."""
    nation = _places(spark, sf)
    cust = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supp = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    undated = [f"{NONE} as timestamp", "cast(null as double) as weight"]
    supplied = (
        table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey")
        .agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("d"), F.sum("l_quantity").alias("q"))
        .join(supp.select("s_suppkey", "case_id"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    rows = [
        cust.selectExpr("case_id", "'C:' || c_custkey as src_id", "'N:' || n_nationkey as tgt_id", "'RESIDENCE_AT' as relation_type",
                        "c_mktsegment as label", "cast(0.72 as double) as confidence_score", *undated),
        supp.selectExpr("case_id", "'S:' || s_suppkey as src_id", "'N:' || n_nationkey as tgt_id", "'LOCATED_IN' as relation_type",
                        "'supplier base' as label", "cast(0.72 as double) as confidence_score", *undated),
        nation.selectExpr("case_id", "'N:' || n_nationkey as src_id", "'R:' || n_regionkey as tgt_id", "'WITHIN' as relation_type",
                          "'nation of region' as label", "cast(null as double) as confidence_score", *undated),
        table(spark, sf, "orders").join(cust.select("c_custkey", "case_id"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
            "case_id", "'O:' || o_orderkey as src_id", "'C:' || o_custkey as tgt_id", "'PARTICIPATED_IN' as relation_type",
            "o_orderpriority as label", "cast(0.48 as double) as confidence_score",
            "date_format(o_orderdate, 'yyyy-MM-dd') as timestamp", "cast(null as double) as weight"),
        supplied.selectExpr("case_id", "'P:' || l_partkey as src_id", "'S:' || l_suppkey as tgt_id", "'SUPPLIED' as relation_type",
                            "'part supplied' as label", "cast(case when n > 1 then 0.82 else 0.72 end as double) as confidence_score",
                            "date_format(d, 'yyyy-MM-dd') as timestamp", "q as weight"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("edge_id", edge_id(F.col("src_id"), F.col("tgt_id"), F.col("relation_type"))).withColumn(
        "raw_phrase", F.lit(None).cast("string")
    )


def trade_nodes(spark: SparkSession, sf: str, edges: DataFrame | None = None) -> DataFrame:
    """Nodes with degree. The records hold one row per node, so no merge is needed here.

    The ends of the edges are counted once and meet the named nodes once; ends without a name are looked up among the parts.
    """
    from caseloom.operators.consolidate import node_records

    edges = trade_edges(spark, sf) if edges is None else edges
    named = node_records(trade_node_records(spark, sf)).select("case_id", "node_id", "label", "entity_type", "summary")
    met = cut_lineage(named.withColumn("_named", F.lit(True)).join(end_counts(edges), ["case_id", "node_id"], "full"))
    parts = met.filter("_named is null").select("case_id", "node_id", "degree").join(
        table(spark, sf, "part").selectExpr("'P:' || p_partkey as node_id", "p_name", "p_type"), "node_id", "left"
    ).select("case_id", "node_id", F.coalesce("p_name", "node_id").alias("label"),
             F.when(F.col("p_name").isNotNull(), "object").otherwise("Other").alias("entity_type"),
             F.col("p_type").alias("summary"), "degree")
    return met.filter("_named").withColumn("degree", F.coalesce("degree", F.lit(0))).drop("_named").unionByName(parts)


_GRAPHS: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def trade_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, written out once per session and data folder: every view reads them several times."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _GRAPHS:
        edges = cut_lineage(trade_edges(spark, sf))
        _GRAPHS[key] = cut_lineage(trade_nodes(spark, sf, edges)), edges
    return _GRAPHS[key]


TRADE_EDGES_SQL = """
place AS (SELECT 'case-' || n_regionkey AS case_id, * FROM nation),
cust AS (SELECT * FROM customer JOIN place ON c_nationkey = n_nationkey),
supp AS (SELECT * FROM supplier JOIN place ON s_nationkey = n_nationkey),
plain_edges AS (
  SELECT case_id, 'C:' || c_custkey AS src_id, 'N:' || n_nationkey AS tgt_id, 'RESIDENCE_AT' AS relation_type,
         c_mktsegment AS label, CAST(0.72 AS DOUBLE) AS confidence_score, CAST(NULL AS VARCHAR) AS "timestamp", CAST(NULL AS DOUBLE) AS weight FROM cust
  UNION ALL SELECT case_id, 'S:' || s_suppkey, 'N:' || n_nationkey, 'LOCATED_IN', 'supplier base', 0.72, NULL, NULL FROM supp
  UNION ALL SELECT case_id, 'N:' || n_nationkey, 'R:' || n_regionkey, 'WITHIN', 'nation of region', NULL, NULL, NULL FROM place
  UNION ALL SELECT case_id, 'O:' || o_orderkey, 'C:' || o_custkey, 'PARTICIPATED_IN', o_orderpriority, 0.48,
         strftime(o_orderdate, '%Y-%m-%d'), NULL FROM orders JOIN cust ON o_custkey = c_custkey
  UNION ALL SELECT case_id, 'P:' || l_partkey, 'S:' || l_suppkey, 'SUPPLIED', 'part supplied',
         CASE WHEN n > 1 THEN 0.82 ELSE 0.72 END, strftime(d, '%Y-%m-%d'), q
  FROM (SELECT l_partkey, l_suppkey, count(*) AS n, min(l_shipdate) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) l
  JOIN supp ON l_suppkey = s_suppkey),
edges AS (SELECT *, 'edge-' || substr(sha1(src_id || '|' || tgt_id || '|' || relation_type), 1, 16) AS edge_id FROM plain_edges)"""

TRADE_GRAPH_SQL = TRADE_EDGES_SQL + """,
named AS (
  SELECT case_id, 'C:' || c_custkey AS node_id, c_name AS label, 'person' AS entity_type, c_mktsegment || ' customer' AS summary FROM cust
  UNION ALL SELECT case_id, 'S:' || s_suppkey, s_name, 'organization', NULL FROM supp
  UNION ALL SELECT case_id, 'N:' || n_nationkey, n_name, 'location', NULL FROM place
  UNION ALL SELECT 'case-' || r_regionkey, 'R:' || r_regionkey, r_name, 'location', NULL FROM region
  UNION ALL SELECT case_id, 'O:' || o_orderkey, 'Order ' || o_orderkey, 'event', o_orderpriority || ' order' FROM orders JOIN cust ON o_custkey = c_custkey),
ends AS (SELECT case_id, src_id AS node_id FROM edges UNION ALL SELECT case_id, tgt_id FROM edges),
degrees AS (SELECT case_id, node_id, count(*) AS degree FROM ends GROUP BY 1, 2),
all_nodes AS (
  SELECT * FROM named
  UNION ALL
  SELECT d.case_id, d.node_id, coalesce(p_name, d.node_id), CASE WHEN p_name IS NULL THEN 'Other' ELSE 'object' END, p_type
  FROM degrees d ANTI JOIN named n ON n.case_id = d.case_id AND n.node_id = d.node_id
  LEFT JOIN part ON 'P:' || p_partkey = d.node_id),
nodes AS (SELECT a.*, coalesce(d.degree, 0) AS degree FROM all_nodes a LEFT JOIN degrees d ON a.case_id = d.case_id AND a.node_id = d.node_id)"""


# --- documents, blocks, chunks -------------------------------------------------------------------

def case_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table as evidence documents of one case per source."""
    labels = table(spark, sf, "labels")
    return table(spark, sf, "documents").join(labels, "doc_id", "left").selectExpr(
        "source as case_id", "'D' || doc_id as document_id", "doc_id || '.txt' as original_filename",
        "source || '/' || doc_id || '.txt' as stored_file_path", "sha2(text, 256) as content_hash",
        "'text/plain' as mime_type", "octet_length(text) as size_bytes", "lang as tags",
        "case when quality is null then 'X4' else case when quality = 1 then 'A' else 'C' end || case when toxic = 1 then '3' else '1' end end as confidence_code",
        "case when quality is null then 'queued' when quality = 1 then 'complete' else 'failed' end as ingestion_status",
        "doc_id as created_ord", "text")


CASE_DOCUMENTS_SQL = """case_documents AS (SELECT source AS case_id, 'D' || d.doc_id AS document_id, d.doc_id || '.txt' AS original_filename,
 source || '/' || d.doc_id || '.txt' AS stored_file_path, sha256(text) AS content_hash, 'text/plain' AS mime_type, strlen(text) AS size_bytes, lang AS tags,
 CASE WHEN quality IS NULL THEN 'X4' ELSE CASE WHEN quality = 1 THEN 'A' ELSE 'C' END || CASE WHEN toxic = 1 THEN '3' ELSE '1' END END AS confidence_code,
 CASE WHEN quality IS NULL THEN 'queued' WHEN quality = 1 THEN 'complete' ELSE 'failed' END AS ingestion_status, d.doc_id AS created_ord, text, lang, d.doc_id
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def content_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a document as a content block; the type follows the line number."""
    lines = table(spark, sf, "documents").select(
        F.col("source").alias("case_id"), F.concat(F.lit("D"), "doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("block_no", "line"))
    null = NONE
    return lines.selectExpr(
        "case_id", "document_id", "block_no", "case block_no % 5 when 0 then 'text' when 1 then 'table' when 2 then 'equation' when 3 then 'Image' else 'note' end as type",
        f"case when block_no % 5 in (0, 2, 4) then line else {null} end as text",
        f"case when block_no % 5 = 1 and block_no % 2 = 1 then line else {null} end as table_body",
        f"case when block_no % 5 = 1 then 'table ' || line else {null} end as table_data",
        f"case when block_no % 5 = 2 and block_no % 2 = 0 then 'x = ' || block_no else {null} end as latex",
        f"case when block_no % 5 = 3 then case when block_no % 2 = 1 then '- Street map: ' || line else 'Abstract logo on a map' end else {null} end as vlm_description",
        f"case when block_no % 5 = 3 then 'Play, 00:01:02:03, ' || line else {null} end as vlm_visible_text",
        "array(0, 0, block_no * 10, 100) as bbox")


CONTENT_BLOCKS_SQL = r"""block_lines AS (SELECT case_id, document_id, generate_subscripts(l, 1) - 1 AS block_no, unnest(l) AS line FROM (
  SELECT source AS case_id, 'D' || doc_id AS document_id, string_split(text, chr(10)) AS l FROM documents)),
labelled AS (SELECT *, list_filter(list_transform(regexp_split_to_array(trim('Play, 00:01:02:03, ' || line, '-* '), '[,\n]'), lambda x: trim(trim(trim(trim(x), '"'), '''')))
  , lambda x: x <> '' AND lower(x) NOT IN ('none', 'n/a', 'null', 'play', 'pause', 'video') AND NOT regexp_full_match(x, '\d{2}:\d{2}:\d{2}:\d{2}')) AS labels FROM block_lines),
block_texts AS (SELECT case_id, document_id, block_no, CASE block_no % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'equation' WHEN 3 THEN 'image' ELSE 'note' END AS type,
  nullif(CASE block_no % 5 WHEN 0 THEN trim(line) WHEN 4 THEN trim(line)
    WHEN 1 THEN coalesce(CASE WHEN block_no % 2 = 1 THEN nullif(trim(line), '') END, trim('table ' || line))
    WHEN 2 THEN concat_ws(chr(10), CASE WHEN block_no % 2 = 0 THEN 'Equation: x = ' || block_no END, nullif(trim(line), ''))
    ELSE concat_ws(chr(10), CASE WHEN len(labels) > 0 THEN 'Image labels: ' || array_to_string(list_filter(labels, lambda x, i: list_position(list_transform(labels, lambda y: lower(y)), lower(x)) = i), '; ') END,
      CASE WHEN block_no % 2 = 1 THEN 'Visual depiction: ' || trim('Street map: ' || line, '-* ') END) END, '') AS body FROM labelled)"""


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from caseloom.operators.textprep import token_chunks

    return token_chunks(case_documents(spark, sf).select("case_id", "document_id", "text"))


DOCUMENT_CHUNKS_SQL = r"""doc_words AS (SELECT source AS case_id, 'D' || doc_id AS document_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents),
chunks AS (SELECT case_id, document_id, document_id || '-' || i AS chunk_id, i AS chunk_order, len(w[i * 550 + 1:i * 550 + 600]) AS tokens, array_to_string(w[i * 550 + 1:i * 550 + 600], ' ') AS content
 FROM (SELECT *, unnest(range(0, greatest(1, ceil((len(w) - 50) / 550.0)::BIGINT))) AS i FROM doc_words WHERE w[1] <> ''))"""


def case_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ingestion jobs: the user is the document worked on."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("case_id"))
    return table(spark, sf, "events").join(docs, F.col("user_id") == F.col("doc_id")).selectExpr(
        "case_id", "'D' || doc_id as document_id", "event_id as job_id",
        "case event_type when 'purchase' then 'complete' when 'error' then 'failed' when 'signup' then 'queued' when 'view' then 'parsing' else 'indexing' end as status",
        "case when event_id % 3 = 0 then 'multimodal' else 'text_first' end as processing_mode",
        "case event_id % 4 when 0 then 'high' when 1 then 'low' else 'normal' end as queue_priority",
        "ts as started_at", "case when event_type = 'purchase' and event_id % 2 = 0 then ts + interval 1 hour end as finished_at")


CASE_JOBS_SQL = """case_jobs AS (SELECT source AS case_id, 'D' || doc_id AS document_id, event_id AS job_id,
 CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing' ELSE 'indexing' END AS status,
 CASE WHEN event_id % 3 = 0 THEN 'multimodal' ELSE 'text_first' END AS processing_mode,
 CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'normal' END AS queue_priority, ts AS started_at,
 CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN ts + INTERVAL 1 HOUR END AS finished_at
 FROM events JOIN documents ON user_id = doc_id)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.col("source").alias("case_id")).agg(F.max("doc_id").alias("m")).selectExpr(
        "case_id", "'Case ' || case_id as name", "lower(case_id) as case_slug", "case when m % 2 = 0 then 'open' else 'closed' end as status",
        "timestamp '2023-06-01' + make_interval(0, 0, 0, cast(m as int)) as updated_at")


CASES_SQL = """cases AS (SELECT source AS case_id, 'Case ' || source AS name, lower(source) AS case_slug, CASE WHEN max(doc_id) % 2 = 0 THEN 'open' ELSE 'closed' END AS status,
 TIMESTAMP '2023-06-01' + INTERVAL 1 DAY * max(doc_id) AS updated_at FROM documents GROUP BY source)"""
