"""Entity resolution over the trade graph and document deletion, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import integrity as dl, resolve as er
from caseloom.operators.similar_names import similar_names, strong_pairs
from caseloom.plans.bindings import (
    CASE_DOCUMENTS_SQL, DOCUMENT_CHUNKS_SQL, NONE, TRADE_GRAPH_SQL, case_documents, document_chunks, table, trade_graph,
)
from caseloom.session import cut_lineage, with_next

QUERIES, ORACLE = {}, {}
SMALL = ", ".join(f"'{w}'" for w in er.SMALL_WORDS)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def already_resolved(nodes):
    return nodes.filter("entity_type = 'location'").select("case_id", F.col("node_id").alias("source"), F.lit("R:0").alias("target"))


@query("er_inventory", f"""WITH {TRADE_GRAPH_SQL}, open_nodes AS (SELECT *, lower(entity_type) AS kind FROM nodes WHERE entity_type <> 'location'),
grouped AS (SELECT * FROM open_nodes QUALIFY count(*) OVER (PARTITION BY case_id, kind) >= 2),
adj AS (SELECT case_id, edge_id, 0 AS side, src_id AS node_id, tgt_id || '(' || relation_type || ')' AS t FROM edges UNION ALL SELECT case_id, edge_id, 1, tgt_id, src_id || '(' || relation_type || ')' FROM edges),
five AS (SELECT *, row_number() OVER (PARTITION BY case_id, node_id ORDER BY edge_id, side) AS rn FROM adj QUALIFY rn <= 5),
listed AS (SELECT case_id, node_id, string_agg(t, ', ' ORDER BY rn) AS nb FROM five GROUP BY 1, 2)
SELECT g.case_id, g.node_id, kind, '  ' || g.node_id || ' | type=' || kind || ' | name=' || label || coalesce(' | description=' || nullif(summary, ''), '') || coalesce(' | neighbours=[' || nb || ']', '') AS line
FROM grouped g LEFT JOIN listed l ON l.case_id = g.case_id AND l.node_id = g.node_id""")
def er_inventory(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    return er.inventory(nodes, edges, already_resolved(nodes))


@query("er_candidates", rf"""WITH {TRADE_GRAPH_SQL}, compared AS (SELECT case_id, node_id, lower(entity_type) AS kind, array_to_string(regexp_extract_all(lower(label), '[\p{{L}}\p{{N}}]+'), ' ') AS name FROM nodes),
names AS (SELECT case_id, kind, name, min(node_id) AS lead FROM compared WHERE name <> '' GROUP BY ALL),
initials AS (SELECT *, unnest(list_filter(list_distinct([array_to_string(list_transform(w, lambda x: x[1]), ''), array_to_string(list_transform(list_filter(w, lambda x: x NOT IN ({SMALL}))
, lambda x: x[1]), '')]), lambda a: length(a) >= 2)) AS acronym FROM (SELECT *, string_split(name, ' ') AS w FROM names WHERE name LIKE '% %')),
found AS (SELECT case_id, kind, lead AS first_id, node_id AS second_id, name AS first_name, name AS second_name, 'same_name' AS reason FROM compared JOIN names USING (case_id, kind, name) WHERE node_id <> lead
UNION ALL SELECT a.case_id, a.kind, a.lead, b.lead, a.name, b.name, 'one_edit' FROM names a JOIN names b ON a.case_id = b.case_id AND a.kind = b.kind AND a.name < b.name AND abs(length(a.name) - length(b.name)) <= 1
 WHERE levenshtein(a.name, b.name) = 1 AND regexp_extract_all(a.name, '[0-9]+') = regexp_extract_all(b.name, '[0-9]+')
UNION ALL SELECT s.case_id, s.kind, s.lead, f.lead, s.name, f.name, 'acronym' FROM names s JOIN initials f ON s.case_id = f.case_id AND s.kind = f.kind AND s.name = f.acronym WHERE s.name NOT LIKE '% %'),
pairs AS (SELECT case_id, kind, first_id, second_id, first_name, second_name, min(reason) AS reason FROM found GROUP BY ALL),
links AS (SELECT case_id, src_id AS a, tgt_id AS b FROM edges UNION SELECT case_id, tgt_id, src_id FROM edges)
SELECT case_id, kind, first_id, second_id, first_name, second_name, reason, round(1 - levenshtein(first_name, second_name) / greatest(length(first_name), length(second_name))::DOUBLE, 6) AS name_similarity,
round(len(list_intersect(string_split(first_name, ' '), string_split(second_name, ' '))) / len(list_distinct(string_split(first_name, ' ') || string_split(second_name, ' ')))::DOUBLE, 6) AS token_overlap,
coalesce(n, 0) AS common_neighbours FROM pairs p LEFT JOIN (SELECT p.case_id, p.kind, p.first_id, p.second_id, count(*) AS n FROM pairs p JOIN links x ON x.case_id = p.case_id AND x.a = p.first_id JOIN links y ON y.case_id = p.case_id AND y.a = p.second_id AND y.b = x.b GROUP BY ALL) USING (case_id, kind, first_id, second_id)""")
def er_candidates(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    rounded = {c: F.round(c, 6) for c in ("name_similarity", "token_overlap")}
    return er.candidate_pairs(nodes, edges).withColumns(rounded)


# --- names that share most of their words: every line of 2 to 12 words in a document is a name of its language ---

def line_names(spark, sf):
    lines = table(spark, sf, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    named = lines.select(F.col("lang").alias("case_id"), F.lit("line").alias("kind"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("line_id"), er.compared_name(F.col("line")).alias("name"))
    short = named.filter(F.size(F.split("name", " ")).between(2, 12))
    return short.groupBy("case_id", "kind", "name").agg(F.min("line_id").alias("name_id"))


TOKEN_PAIRS_SQL = r"""lines AS (SELECT lang AS case_id, doc_id * 100000 + generate_subscripts(l, 1) - 1 AS line_id, unnest(l) AS line FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS l FROM documents)),
split AS (SELECT case_id, line_id, regexp_extract_all(lower(line), '[\p{L}\p{N}]+') AS w FROM lines),
names AS (SELECT case_id, array_to_string(w, ' ') AS name, min(line_id) AS name_id, list_sort(list_distinct(any_value(w))) AS w, regexp_extract_all(array_to_string(any_value(w), ' '), '[0-9]+') AS numbers FROM split WHERE len(w) BETWEEN 2 AND 12 GROUP BY case_id, name),
sizes AS (SELECT case_id, count(*) AS size FROM names GROUP BY 1),
weights AS (SELECT case_id, word, round(1000 * ln(1 + max(size)::DOUBLE / count(*)))::BIGINT AS weight FROM (SELECT case_id, unnest(w) AS word FROM names) JOIN sizes USING (case_id) GROUP BY ALL),
totals AS (SELECT case_id, name_id, sum(weight)::BIGINT AS total FROM (SELECT case_id, name_id, unnest(w) AS word FROM names) JOIN weights USING (case_id, word) GROUP BY ALL),
met AS (SELECT a.case_id, a.name_id AS first_id, b.name_id AS second_id, list_intersect(a.w, b.w) AS held FROM names a JOIN names b ON a.case_id = b.case_id AND a.name_id < b.name_id AND a.numbers = b.numbers WHERE list_has_any(a.w, b.w)),
sums AS (SELECT case_id, first_id, second_id, sum(weight)::BIGINT AS shared FROM (SELECT case_id, first_id, second_id, unnest(held) AS word FROM met) JOIN weights USING (case_id, word) GROUP BY ALL),
pairs AS (SELECT s.*, a.total + b.total - shared AS joint FROM sums s JOIN totals a ON a.case_id = s.case_id AND a.name_id = first_id JOIN totals b ON b.case_id = s.case_id AND b.name_id = second_id
 WHERE shared * 100 >= (a.total + b.total - shared) * 50)"""


@query("er_token_pairs", f"WITH {TOKEN_PAIRS_SQL} SELECT case_id, first_id, second_id, shared, joint FROM pairs")
def er_token_pairs(spark, sf):
    return similar_names(line_names(spark, sf), 50).drop("kind")


@query("er_strong_pairs", f"""WITH {TOKEN_PAIRS_SQL}, ends AS (SELECT case_id, shared, unnest([first_id, second_id]) AS name_id FROM pairs), means AS (SELECT case_id, name_id, avg(shared) AS mean FROM ends GROUP BY ALL)
SELECT p.* FROM pairs p JOIN means a ON a.case_id = p.case_id AND a.name_id = first_id JOIN means b ON b.case_id = p.case_id AND b.name_id = second_id WHERE shared >= least(a.mean, b.mean) - 1e-9""")
def er_strong_pairs(spark, sf):
    return strong_pairs(cut_lineage(similar_names(line_names(spark, sf), 50))).drop("kind")


def proposals(spark, sf):
    """Each part proposes its successor of the same name, with a confidence from its size."""
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_name")
    return with_next(part, ["p_name"], ["p_partkey"], "p_partkey", "n").filter("n is not null").selectExpr(
        "'parts' as case_id", "p_partkey * 7919 % 10007 * 100000 + p_partkey as ord", "'P:' || p_partkey as source", "'P:' || n as target", "0.8 + p_size / 250.0 as confidence")


def part_nodes(spark, sf):
    return table(spark, sf, "part").selectExpr("'parts' as case_id", "'P:' || p_partkey as node_id", "p_name as label", "'object' as entity_type", "p_type as summary")


def accepted_merges(spark, sf):
    nodes = part_nodes(spark, sf)
    return er.accept_proposals(proposals(spark, sf), nodes, nodes.filter("summary = 'PROMO'").select("case_id", F.col("node_id").alias("source"), F.lit("x").alias("target")))


# a chain proposal's only rival is the next one of its chain: it fails if that one came earlier and was accepted
ACCEPTED_SQL = """chain AS (SELECT p_partkey AS k, lead(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS n, p_name, p_size, p_type, lead(p_type) OVER (PARTITION BY p_name ORDER BY p_partkey) AS nt FROM part),
props AS (SELECT *, k * 7919 % 10007 * 100000 + k AS ord FROM chain WHERE n IS NOT NULL AND 0.8 + p_size / 250.0 >= 0.85 AND p_type <> 'PROMO' AND nt <> 'PROMO'),
later AS (SELECT a.*, b.k AS rival, b.ord < a.ord AS before FROM props a LEFT JOIN props b ON b.k = a.n),
walk AS (SELECT k, n, ord, k AS at, 0 AS depth FROM later UNION ALL SELECT w.k, w.n, w.ord, l.rival, depth + 1 FROM walk w JOIN later l ON l.k = w.at WHERE l.before),
accepted AS (SELECT k, n, ord FROM walk GROUP BY ALL HAVING max(depth) % 2 = 0)"""


@query("er_accept", f"WITH RECURSIVE {ACCEPTED_SQL} SELECT 'parts' AS case_id, ord, 'P:' || k AS source, 'P:' || n AS target FROM accepted")
def er_accept(spark, sf):
    return accepted_merges(spark, sf).select("case_id", "ord", "source", "target")


ROOTS_SQL = """roots AS (SELECT k, n AS root FROM accepted WHERE n NOT IN (SELECT k FROM accepted) UNION ALL SELECT a.k, r.root FROM accepted a JOIN roots r ON a.n = r.k)"""


@query("er_roots", f"WITH RECURSIVE {ACCEPTED_SQL}, {ROOTS_SQL} SELECT 'parts' AS case_id, 'P:' || k AS source, 'P:' || root AS root FROM roots")
def er_roots(spark, sf):
    return er.merge_roots(accepted_merges(spark, sf))


def part_edges(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"), F.min("l_shipdate").alias("d")).selectExpr(
        "'parts' as case_id", "'P:' || l_partkey as src_id", "'S:' || l_suppkey as tgt_id", "'SUPPLIED' as relation_type", "'e' || l_partkey || '-' || l_suppkey as edge_id",
        "'supply ' || l_partkey as label", "cast(0.72 as double) as confidence_score", "date_format(d, 'yyyy-MM-dd') as timestamp", "weight")


@query("er_merge", f"""WITH RECURSIVE {ACCEPTED_SQL}, {ROOTS_SQL}, e AS (SELECT coalesce(root, l_partkey) AS p, l_suppkey, 'e' || l_partkey || '-' || l_suppkey AS old, 'supply ' || l_partkey AS label, strftime(d, '%Y-%m-%d') AS ts, q
FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q, min(l_shipdate) AS d FROM lineitem GROUP BY 1, 2) LEFT JOIN roots ON k = l_partkey)
SELECT 'parts' AS case_id, 'edge-' || substr(sha1('P:' || p || '|S:' || l_suppkey || '|SUPPLIED'), 1, 16) AS edge_id, 'P:' || p AS src_id, 'S:' || l_suppkey AS tgt_id, arg_min(label, old) AS label, arg_min(ts, old) AS "timestamp", max(q) AS weight FROM e GROUP BY p, l_suppkey""")
def er_merge(spark, sf):
    return er.merge_edges_after(part_edges(spark, sf), er.merge_roots(accepted_merges(spark, sf))).drop("relation_type", "confidence_score")


@query("er_merged_nodes", f"""WITH RECURSIVE {ACCEPTED_SQL}, {ROOTS_SQL}, members AS (SELECT root, k FROM roots UNION SELECT root, root FROM roots)
SELECT 'P:' || root AS node_id, 'P:' || k AS member_id, p_type AS summary FROM members JOIN part ON p_partkey = k UNION ALL SELECT 'P:' || p_partkey, NULL, 'person' FROM part WHERE p_partkey NOT IN (SELECT k FROM roots)""")
def er_merged_nodes(spark, sf):
    roots = er.merge_roots(accepted_merges(spark, sf))
    nodes = part_nodes(spark, sf)
    kept = er.merge_nodes(nodes.withColumn("entity_type", F.lit("person")), roots)
    return er.merged_descriptions(nodes, roots).select("node_id", "member_id", "summary").unionByName(
        kept.select("node_id", F.lit(None).cast("string").alias("member_id"), F.col("entity_type").alias("summary")))


@query("er_merged_sources", f"""WITH RECURSIVE {ACCEPTED_SQL}, {ROOTS_SQL}
SELECT DISTINCT 'P:' || coalesce(root, l_partkey) AS node_id, 'S' || l_suppkey AS source_id FROM lineitem LEFT JOIN roots ON k = l_partkey""")
def er_merged_sources(spark, sf):
    """Which suppliers each part, alone or merged, is known from."""
    sources = table(spark, sf, "lineitem").selectExpr("'parts' as case_id", "'P:' || l_partkey as node_id", "'S' || l_suppkey as source_id")
    return er.merged_sources(sources, er.merge_roots(accepted_merges(spark, sf))).select("node_id", "source_id")


@query("er_requests", """SELECT DISTINCT 'parts' AS case_id, o_orderkey AS request_id, 'P:' || (o_custkey * 2) AS source, 'P:' || o_orderkey AS target FROM orders WHERE o_custkey * 2 <> o_orderkey AND o_orderkey % 7 <> 0""")
def er_requests(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("'parts' as case_id", "o_orderkey as request_id", "' P:' || (o_custkey * 2) as source",
                                                 "case when o_orderkey % 7 = 0 then '  ' else 'P:' || o_orderkey || ' ' end as target")
    return er.merge_requests(rows.unionByName(rows))


@query("er_unknown", """SELECT 'parts' AS case_id, o_orderkey AS request_id, 'P:' || (o_custkey * 2) AS node_id FROM orders WHERE o_custkey * 2 NOT IN (SELECT p_partkey FROM part)
UNION SELECT 'parts', o_orderkey, 'P:' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)""")
def er_unknown(spark, sf):
    requests = table(spark, sf, "orders").selectExpr("'parts' as case_id", "o_orderkey as request_id", "' P:' || (o_custkey * 2) as source", "'P:' || o_orderkey || ' ' as target")
    return er.unknown_entities(requests, part_nodes(spark, sf))


@query("er_state", f"""WITH RECURSIVE {ACCEPTED_SQL} SELECT 'parts' AS case_id, (SELECT count(*) FROM part WHERE p_type = 'PROMO') + (SELECT count(*) FROM accepted) AS resolved_count, (SELECT count(*) FROM accepted) AS merged_count,
(SELECT count(*) FROM part WHERE p_type = 'PROMO') AS skipped_already_resolved""")
def er_state(spark, sf):
    before = part_nodes(spark, sf).filter("summary = 'PROMO'").select("case_id", F.col("node_id").alias("source"), F.lit("x").alias("target"))
    return er.resolution_state(before, accepted_merges(spark, sf))[1]


# --- deletion: the documents labelled toxic go ---------------------------------------------------

def toxic_documents(spark, sf):
    return case_documents(spark, sf).filter("substr(confidence_code, 2) = '3'").select("case_id", "document_id")


def chunk_rows(spark, sf):
    return document_chunks(spark, sf).selectExpr("case_id", "document_id", "chunk_id", "'alias-' || chunk_id as alias", f"{NONE} as source_id")


def doomed_tokens(spark, sf):
    chunks = chunk_rows(spark, sf)
    # the chunks of Spanish documents are not on record
    known = chunks.join(case_documents(spark, sf).filter("tags <> 'es'").select("document_id"), "document_id", "left_semi")
    return dl.document_tokens(toxic_documents(spark, sf), known.select("case_id", "document_id", "chunk_id"), known.select(*chunks.columns))


def vector_records(spark, sf):
    """A record per document on its own chunk and its successor's, one per chunk by alias."""
    docs = case_documents(spark, sf).select("case_id", "document_id", "stored_file_path", "created_ord")
    entities = with_next(docs, ["case_id"], ["created_ord"], "document_id", "n").selectExpr(
        "case_id", "'V' || document_id as record_id", f"{NONE} as document_id", "document_id || '-0' || coalesce('<SEP>' || n || '-0', '') as source_id", f"{NONE} as chunk_id", "stored_file_path as file_path")
    chunks = chunk_rows(spark, sf).selectExpr("case_id", "'W' || chunk_id as record_id", f"{NONE} as document_id", f"{NONE} as source_id", "alias as chunk_id", f"{NONE} as file_path")
    return entities.unionByName(chunks)


DELETE_SQL = f"""{CASE_DOCUMENTS_SQL}, {DOCUMENT_CHUNKS_SQL}, doomed AS (SELECT * FROM case_documents WHERE substr(confidence_code, 2) = '3'),
gone AS (SELECT c.case_id, chunk_id FROM chunks c JOIN doomed d ON d.document_id = c.document_id WHERE lang <> 'es')"""


@query("delete_cascade", f"""WITH {DELETE_SQL}, pairs AS (SELECT case_id, document_id, stored_file_path, lang, lead(document_id) OVER (PARTITION BY case_id ORDER BY created_ord) AS n FROM case_documents)
SELECT case_id, 'V' || document_id AS record_id FROM pairs WHERE document_id || '-0' NOT IN (SELECT chunk_id FROM gone) AND coalesce(n || '-0', '') NOT IN (SELECT chunk_id FROM gone)
 AND stored_file_path NOT IN (SELECT stored_file_path FROM doomed x WHERE x.lang = 'es' OR NOT EXISTS (SELECT 1 FROM gone g WHERE starts_with(g.chunk_id, x.document_id || '-')))
UNION ALL SELECT case_id, 'W' || chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)""")
def delete_cascade(spark, sf):
    paths = case_documents(spark, sf).select("case_id", "document_id", F.col("stored_file_path").alias("file_path"))
    tokens = cut_lineage(doomed_tokens(spark, sf))
    return dl.delete_vectors(vector_records(spark, sf), toxic_documents(spark, sf), tokens, paths).select("case_id", "record_id")


@query("delete_chunks", f"WITH {DELETE_SQL} SELECT case_id, chunk_id FROM chunks WHERE document_id NOT IN (SELECT document_id FROM doomed)")
def delete_chunks(spark, sf):
    return dl.delete_rows(chunk_rows(spark, sf), toxic_documents(spark, sf), "document_id").select("case_id", "chunk_id")


@query("prune_lists", f"""WITH {DELETE_SQL} SELECT case_id, 'order-' || chunk_order AS owner, count(*) AS count FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM gone) GROUP BY 1, 2""")
def prune_lists(spark, sf):
    links = document_chunks(spark, sf).select("case_id", F.concat(F.lit("order-"), "chunk_order").alias("owner"), "chunk_id")
    return dl.chunk_list_counts(dl.prune_chunk_lists(links, doomed_tokens(spark, sf)))


@query("orphans", f"WITH {DELETE_SQL} SELECT DISTINCT case_id, document_id FROM chunks WHERE document_id IN (SELECT document_id FROM doomed)")
def orphans(spark, sf):
    docs = case_documents(spark, sf)
    active = docs.join(toxic_documents(spark, sf), ["case_id", "document_id"], "left_anti")
    return dl.orphan_documents([document_chunks(spark, sf), active], active)


@query("emptied_cases", f"WITH {DELETE_SQL} SELECT case_id, chunk_id FROM chunks WHERE case_id IN (SELECT case_id FROM case_documents WHERE ingestion_status = 'failed')")
def emptied_cases(spark, sf):
    return dl.drop_emptied_cases(chunk_rows(spark, sf), case_documents(spark, sf).filter("ingestion_status = 'failed'")).select("case_id", "chunk_id")
