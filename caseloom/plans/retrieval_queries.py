"""Retrieval over the embeddings: each label's mean vector is a question, every vector an entity and a chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import retrieve as rt, vector_index as vi
from caseloom.plans.bindings import CASE_DOCUMENTS_SQL, case_documents, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def vectors(spark, sf, prefix):
    return table(spark, sf, "embeddings").selectExpr("'vec' as case_id", f"'{prefix}' || vec_id as item_id", "embedding as vector")


def label_questions(spark, sf):
    items = table(spark, sf, "embeddings").selectExpr("'q' || label as query_id", "embedding as vector")
    return rt.mean_vectors(items, "query_id").withColumn("case_id", F.lit("vec"))


def vector_edges(spark, sf):
    """Each vector is linked to the next one; the link has the vector of its source."""
    v = table(spark, sf, "embeddings").select("vec_id")
    return v.join(v.selectExpr("vec_id - 1 as vec_id"), "vec_id").selectExpr(
        "'vec' as case_id", "'R' || vec_id as edge_id", "'E' || vec_id as src_id", "'E' || (vec_id + 1) as tgt_id")


def owner_sources(spark, sf):
    """Entities come from their own chunk, links from the chunk of every tenth vector before them."""
    nodes = table(spark, sf, "embeddings").selectExpr("'vec' as case_id", "'E' || vec_id as owner_id", "'K' || vec_id as chunk_id")
    links = vector_edges(spark, sf).selectExpr("case_id", "edge_id as owner_id", "'K' || (cast(substr(edge_id, 2) as long) div 10 * 10) as chunk_id")
    return nodes.unionByName(links)


def entity_hits(spark, sf):
    return rt.vector_topk(label_questions(spark, sf), vectors(spark, sf, "E"), 10, 0.2)


def relation_hits(spark, sf):
    edges = vector_edges(spark, sf).select(F.col("edge_id").alias("item_id"))
    return rt.vector_topk(label_questions(spark, sf), vectors(spark, sf, "R").join(edges, "item_id", "left_semi"), 10, 0.2)


def local_mode(spark, sf):
    return rt.mode_local(entity_hits(spark, sf), vector_edges(spark, sf), owner_sources(spark, sf))


def global_mode(spark, sf):
    return rt.mode_global(relation_hits(spark, sf), vector_edges(spark, sf), owner_sources(spark, sf))


def _topk_sql(name: str, prefix: str, source: str = "embeddings") -> str:
    return f"""{name} AS (SELECT query_id, '{prefix}' || vec_id AS item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, '{prefix}' || vec_id) AS rank FROM (
 SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score FROM questions, {source}) WHERE score >= 0.2 QUALIFY rank <= 10)"""


BASE_SQL = f"""questions AS (SELECT 'q' || label AS query_id, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
linked AS (SELECT e.* FROM embeddings e WHERE EXISTS (SELECT 1 FROM embeddings n WHERE n.vec_id = e.vec_id + 1)),
edges AS (SELECT 'R' || vec_id AS edge_id, 'E' || vec_id AS src_id, 'E' || (vec_id + 1) AS tgt_id FROM linked),
sources AS (SELECT 'E' || vec_id AS owner_id, 'K' || vec_id AS chunk_id FROM embeddings UNION ALL SELECT 'R' || vec_id, 'K' || (vec_id // 10 * 10) FROM linked),
{_topk_sql('ent', 'E')}, {_topk_sql('rel', 'R', 'linked')}, {_topk_sql('chk', 'K')}"""


def _mode_sql(name: str, entities: str, relations: str) -> str:
    return f"""{name}_own AS ({entities} UNION ALL {relations}),
{name}_chunks AS (SELECT query_id, chunk_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), -count(*), chunk_id) AS place FROM {name}_own JOIN sources ON owner_id = item_id GROUP BY query_id, chunk_id QUALIFY place <= 10),
{name} AS (SELECT * FROM {name}_own UNION ALL SELECT query_id, 'chunk', item_id, place FROM {name}_chunks)"""


LOCAL_SQL = _mode_sql("loc", "SELECT query_id, 'entity' AS kind, item_id, rank FROM ent",
    "SELECT query_id, 'relation', edge_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), edge_id) AS place FROM ent JOIN edges ON item_id IN (src_id, tgt_id) GROUP BY query_id, edge_id QUALIFY place <= 10")
GLOBAL_SQL = _mode_sql("glo", """SELECT query_id, 'entity' AS kind, node_id AS item_id, place AS rank FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), node_id) AS place
 FROM rel JOIN (SELECT edge_id, unnest([src_id, tgt_id]) AS node_id FROM edges) ON edge_id = item_id GROUP BY query_id, node_id QUALIFY place <= 10)""",
    "SELECT query_id, 'relation', item_id, rank FROM rel")


def _merged(*lists: str) -> str:
    n = len(lists)
    union = " UNION ALL ".join(f"SELECT query_id, kind, item_id, (rank - 1) * {n} + {i} AS place FROM {l}" for i, l in enumerate(lists))
    return f"""SELECT query_id, 'vec' AS case_id, kind, item_id, row_number() OVER (PARTITION BY query_id, kind ORDER BY min(place), item_id) AS rank FROM ({union}) GROUP BY query_id, kind, item_id"""


@query("vector_topk", f"WITH {BASE_SQL} SELECT query_id, 'vec' AS case_id, item_id, rank, round(score, 6) AS score FROM ent")
def vector_topk(spark, sf):
    return entity_hits(spark, sf).withColumn("score", F.round("score", 6))


def neighbour_questions(spark, sf):
    """Every vector asks for its nearest other vectors inside its label's case."""
    return table(spark, sf, "embeddings").selectExpr("'q' || vec_id as query_id", "'label-' || label as case_id", "embedding as vector")


@query("vector_neighbours", """SELECT query_id, case_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
SELECT 'q' || a.vec_id AS query_id, 'label-' || a.label AS case_id, 'E' || b.vec_id AS item_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
FROM embeddings a JOIN embeddings b ON a.label = b.label) WHERE score >= 0.2) WHERE rank <= 5""")
def vector_neighbours(spark, sf):
    items = table(spark, sf, "embeddings").selectExpr("'label-' || label as case_id", "'E' || vec_id as item_id", "embedding as vector")
    return rt.vector_topk(neighbour_questions(spark, sf), items, 5, 0.2).withColumn("score", F.round("score", 6))


@query("mode_naive", f"WITH {BASE_SQL} SELECT query_id, 'vec' AS case_id, 'chunk' AS kind, item_id, rank FROM chk")
def mode_naive(spark, sf):
    return rt.mode_naive(rt.vector_topk(label_questions(spark, sf), vectors(spark, sf, "K"), 10, rt.NAIVE_THRESHOLD))


@query("mode_local", f"WITH {BASE_SQL}, {LOCAL_SQL} SELECT query_id, 'vec' AS case_id, kind, item_id, rank FROM loc")
def mode_local(spark, sf):
    return local_mode(spark, sf)


@query("mode_global", f"WITH {BASE_SQL}, {GLOBAL_SQL} SELECT query_id, 'vec' AS case_id, kind, item_id, rank FROM glo")
def mode_global(spark, sf):
    return global_mode(spark, sf)


@query("mode_hybrid", f"WITH {BASE_SQL}, {LOCAL_SQL}, {GLOBAL_SQL} {_merged('loc', 'glo')}")
def mode_hybrid(spark, sf):
    return rt.interleave(local_mode(spark, sf), global_mode(spark, sf))


@query("mode_mix", f"WITH {BASE_SQL}, {LOCAL_SQL}, {GLOBAL_SQL}, nai AS (SELECT query_id, 'chunk' AS kind, item_id, rank FROM chk) {_merged('loc', 'glo', 'nai')}")
def mode_mix(spark, sf):
    return rt.interleave(local_mode(spark, sf), global_mode(spark, sf), mode_naive(spark, sf))


@query("rerank", f"""WITH {BASE_SQL}, s AS (SELECT query_id, item_id, rank AS old_rank, CASE WHEN label % 2 = 0 THEN round(embedding[1]::DOUBLE, 6) ELSE 1 - (rank - 1) * 0.01::DOUBLE END AS score FROM ent JOIN embeddings ON item_id = 'E' || vec_id)
SELECT query_id, item_id, old_rank, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank FROM s""")
def rerank(spark, sf):
    scores = table(spark, sf, "embeddings").filter("label % 2 = 0").selectExpr("'E' || vec_id as item_id", "round(cast(embedding[0] as double), 6) as score")
    hits = entity_hits(spark, sf).select("query_id", "item_id", "rank")
    scored = hits.select("query_id", "item_id").join(scores, "item_id")
    return rt.rerank(hits, scored).withColumn("score", F.round("score", 6))


def retrieved_references(spark, sf):
    """Every document asks about its own file and its successor's, under packed and foreign paths."""
    return case_documents(spark, sf).selectExpr(
        "'q' || tags as query_id", "case_id", "created_ord as pos", "case when created_ord % 3 = 0 then '' else 'ref' || created_ord % 50 end as reference_id",
        "case created_ord % 4 when 0 then 'gone.txt<SEP>X/' || upper(original_filename) when 1 then stored_file_path when 2 then ' ' || original_filename || ' <SEP>' || stored_file_path else 'missing/none.bin' end as file_path",
        "text as content")


REFERENCES_SQL = """asked AS (SELECT 'q' || lang AS query_id, case_id, created_ord AS pos, CASE WHEN created_ord % 3 = 0 THEN '' ELSE 'ref' || created_ord % 50 END AS reference_id, stored_file_path AS file_path, trim(text, ' ' || chr(10)) AS t, text AS content
 FROM case_documents WHERE created_ord % 4 < 3),
refs AS (SELECT query_id, case_id, reference_id, file_path, min(pos) AS pos FROM asked WHERE reference_id <> '' GROUP BY ALL)"""


@query("reference_resolve", f"WITH {CASE_DOCUMENTS_SQL}, {REFERENCES_SQL} SELECT * FROM refs")
def reference_resolve(spark, sf):
    return rt.normalise_references(retrieved_references(spark, sf), case_documents(spark, sf))


@query("chunk_resolve", f"""WITH {CASE_DOCUMENTS_SQL}, {REFERENCES_SQL} SELECT query_id, case_id, reference_id, file_path, CASE WHEN length(t) > 480 THEN rtrim(left(t, 477), ' ' || chr(10)) || '...' ELSE t END AS snippet, pos, content AS full_text
FROM asked WHERE reference_id <> ''""")
def chunk_resolve(spark, sf):
    asked, docs = retrieved_references(spark, sf), case_documents(spark, sf)
    return rt.normalise_chunks(asked, rt.normalise_references(asked, docs), docs)


def raw_records(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "'q' || o_custkey as query_id", "o_orderkey as pos", "case when o_orderkey % 3 = 0 then 'O' || o_orderkey % 100 end as entity_id", "case when o_orderkey % 3 = 1 then ' N' || o_orderkey % 100 else '' end as name",
        "case when o_orderkey % 2 = 0 then upper(o_orderstatus) end as category", "'C' || o_custkey as source", "'O' || o_orderkey % 100 as to", "case when o_orderkey % 4 = 0 then 'paid, sent' end as keywords",
        "case when o_orderkey % 4 = 1 then o_orderpriority end as predicate", "case when o_orderkey % 4 = 2 then 'a__seen_by__b' || o_orderkey % 10 end as edge_id")


RECORDS_SQL = """ents AS (SELECT query_id, id, arg_min(type, pos) AS type, min(pos) AS pos FROM (SELECT 'q' || o_custkey AS query_id, o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN 'O' || o_orderkey % 100 WHEN 1 THEN 'N' || o_orderkey % 100 END AS id,
 CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE '' END AS type FROM orders) WHERE id IS NOT NULL GROUP BY 1, 2),
rels AS (SELECT query_id, id, arg_min(type, pos) AS type, min(pos) AS pos, any_value(src_id) AS src_id, arg_min(tgt_id, pos) AS tgt_id FROM (SELECT 'q' || o_custkey AS query_id, o_orderkey AS pos, 'C' || o_custkey AS src_id, 'O' || o_orderkey % 100 AS tgt_id,
 CASE o_orderkey % 4 WHEN 0 THEN 'PAID' WHEN 1 THEN upper(o_orderpriority) WHEN 2 THEN 'SEEN_BY' ELSE 'REL' END AS type,
 CASE WHEN o_orderkey % 4 = 2 THEN 'a__seen_by__b' || o_orderkey % 10 ELSE 'C' || o_custkey || '__' || CASE o_orderkey % 4 WHEN 0 THEN 'PAID' WHEN 1 THEN upper(o_orderpriority) ELSE 'REL' END || '__O' || o_orderkey % 100 END AS id FROM orders) GROUP BY 1, 2)"""


@query("entity_records", f"WITH {RECORDS_SQL} SELECT query_id, id, type, pos FROM ents")
def entity_records(spark, sf):
    return rt.entity_records(raw_records(spark, sf))


@query("relation_records", f"WITH {RECORDS_SQL} SELECT query_id, pos, id, type, src_id, tgt_id FROM rels")
def relation_records(spark, sf):
    return rt.relation_records(raw_records(spark, sf))


def _first_sql(rows: str, case: str) -> str:
    return f"""(SELECT query_id, string_agg(id, ',' ORDER BY rn) AS ids, coalesce(string_agg({case}(nullif(type, '')), ',' ORDER BY rn), '') AS types FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, id) AS rn FROM {rows}) JOIN asked USING (query_id) WHERE rn <= top_k GROUP BY 1)"""


@query("retrieval_eval", f"""WITH {RECORDS_SQL}, asked AS (SELECT 'q' || c_custkey AS query_id, 'hybrid' AS mode, CASE c_custkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 100 ELSE 5 END AS top_k FROM customer)
SELECT query_id, mode, top_k, coalesce(e.ids, '') AS entity_ids, coalesce(e.types, '') AS entity_types, coalesce(r.ids, '') AS relation_ids, coalesce(r.types, '') AS relation_types,
e.ids IS NOT NULL AS entities_present, r.ids IS NOT NULL AS relations_present, e.ids IS NOT NULL OR r.ids IS NOT NULL AS non_empty_payload
FROM asked LEFT JOIN {_first_sql('ents', 'lower')} e USING (query_id) LEFT JOIN {_first_sql('rels', 'upper')} r USING (query_id)""")
def retrieval_eval(spark, sf):
    raw = raw_records(spark, sf)
    asked = table(spark, sf, "customer").selectExpr("'q' || c_custkey as query_id", "'hybrid' as mode", "case c_custkey % 4 when 0 then '7.9' when 1 then '200' when 2 then 'x' else '-1' end as top_k")
    return rt.retrieval_report(asked, rt.entity_records(raw), rt.relation_records(raw))


@query("refusals", """SELECT 'q' || c_custkey AS query_id, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 < 2) AS insufficient_evidence FROM customer""")
def refusals(spark, sf):
    return rt.insufficient_evidence(table(spark, sf, "customer").selectExpr("'q' || c_custkey as query_id"), rt.entity_records(raw_records(spark, sf)))


@query("refusals_all", """WITH kept AS (SELECT * FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 3 < 2 UNION ALL SELECT * FROM orders WHERE o_orderkey % 11 = 1 UNION ALL SELECT * FROM orders WHERE o_orderkey % 11 = 2 AND o_totalprice > 100000)
SELECT 'q' || c_custkey AS query_id, NOT EXISTS (SELECT 1 FROM kept WHERE o_custkey = c_custkey) AS insufficient_evidence FROM customer""")
def refusals_all(spark, sf):
    """Entities, relations and chunks of a question each come from other orders; one find of any kind is enough."""
    raw = raw_records(spark, sf)
    chunks = table(spark, sf, "orders").filter("o_orderkey % 11 = 2 and o_totalprice > 100000").selectExpr("'q' || o_custkey as query_id", "o_orderkey as chunk_id")
    return rt.insufficient_evidence(table(spark, sf, "customer").selectExpr("'q' || c_custkey as query_id"),
                                    rt.entity_records(raw.filter("pos % 11 = 0")), rt.relation_records(raw.filter("pos % 11 = 1")), chunks)


# --- the approximate index: every vector whose id is divisible by 20 is asked against all ---

def sampled_questions(spark, sf):
    return vectors(spark, sf, "E").filter("cast(substr(item_id, 2) as long) % 20 = 0").select(F.concat(F.lit("n"), "item_id").alias("query_id"), "case_id", "vector")


@query("vector_ann")
def vector_ann(spark, sf):
    return vi.approximate_topk(vi.build(vectors(spark, sf, "E")), sampled_questions(spark, sf), 10, 0.2)


@query("vector_ann_recall", "SELECT count(*) AS questions, true AS nine_of_ten FROM embeddings WHERE vec_id % 20 = 0")
def vector_ann_recall(spark, sf):
    """Whether at least nine of ten exact hits are found, over all questions."""
    asked = sampled_questions(spark, sf)
    rate = vi.recall(vector_ann(spark, sf), rt.vector_topk(asked, vectors(spark, sf, "E"), 10, 0.2))
    return rate.select(F.lit(asked.count()).alias("questions"), (F.col("hits") * 10 >= F.col("wanted") * 9).alias("nine_of_ten"))


@query("vector_ann_full", f"""WITH {BASE_SQL} SELECT query_id, item_id, rank, round(score, 6) AS score FROM ent""")
def vector_ann_full(spark, sf):
    """With all lists probed and a shortlist of all items the index gives the exact hits."""
    index = vi.build(vectors(spark, sf, "E"))
    everything = index.codes.count()
    hits = vi.approximate_topk(index, label_questions(spark, sf), 10, 0.2, probes=len(index.quantiser.centres), shortlist=everything)
    return hits.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))
