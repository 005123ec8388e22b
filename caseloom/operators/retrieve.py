"""Vector and graph retrieval for batches of questions, and the tidying of what was retrieved."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import LIST_SEPARATOR, clip, pick_text, strip
from caseloom.functions.vectors import TopK, stack, unit_rows
from caseloom.session import number_rows, top_per_key

# Thresholds and limits of retrieval.
THRESHOLD, NAIVE_THRESHOLD, TOP_K = 0.45, 0.20, 10
EVAL_TOP_K, MAX_TOP_K = 5, 100
CHUNK_SNIPPET = 480

#: Queries and vectors that meet in one task.
BLOCK_QUERIES, SHARD_VECTORS = 1024, 20_000
FOUND = "query_id string, case_id string, item_id string, score double"


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """Best k items per query by cosine inside the query's case, exactly.

    queries(query_id, case_id, vector), vectors(case_id, item_id, vector). A case's queries are cut into blocks and its
    vectors into shards by hash; every block meets every shard of its own case in a task of bounded size, and each
    task returns k rows per query at most. A case without queries or without vectors is never copied.
    """
    asked = queries.select(F.col("query_id").cast("string"), "case_id", "vector")
    # named anew, so that the two sides stay apart where both come from one table
    items = vectors.select(F.col("case_id").alias("case_id"), F.col("item_id").cast("string"), F.col("vector").alias("vector"))

    def parts(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))

    sizes = parts(asked, BLOCK_QUERIES, "blocks").join(parts(items, SHARD_VECTORS, "shards"), "case_id")

    def part(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def copies(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = asked.join(sizes, "case_id").withColumn("block", part("query_id", "blocks")).withColumn("shard", copies("shards")).drop("blocks", "shards")
    right = items.join(sizes, "case_id").withColumn("shard", part("item_id", "shards")).withColumn("block", copies("blocks")).drop("blocks", "shards")

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        ids, cases = q["query_id"].to_numpy(object), q["case_id"].to_numpy(object)
        top = TopK(len(ids), k, threshold)
        if len(q) and len(v):
            top.add(unit_rows(stack(q["vector"])), cases, unit_rows(stack(v["vector"])), v["item_id"].to_numpy(object), v["case_id"].to_numpy(object))
        return pd.DataFrame(list(top.rows(ids, cases)), columns=["query_id", "case_id", "item_id", "score"])

    where = ["case_id", "block", "shard"]
    partial = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(meet, FOUND)
    return top_per_key(partial, ["query_id", "case_id"], [F.col("score").desc(), F.col("item_id")], k)


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key, component by component, so a large group is summed in parts."""
    parts = vectors.select(key, F.posexplode("vector").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return parts.groupBy(key).agg(F.transform(ordered, lambda s: s["x"]).alias("vector"))


def _ranked(found: DataFrame, kind: str, order: list[Column], k: int) -> DataFrame:
    return top_per_key(found, ["query_id", "case_id"], order, k).select("query_id", "case_id", F.lit(kind).alias("kind"), "item_id", "rank")


def mode_naive(chunk_hits: DataFrame) -> DataFrame:
    return chunk_hits.select("query_id", "case_id", F.lit("chunk").alias("kind"), "item_id", "rank")


def _chunks_of(owners: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Source chunks of ranked owners: best owner first, then the more often named chunk."""
    named = owners.join(sources, ["case_id", "owner_id"]).groupBy("query_id", "case_id", F.col("chunk_id").alias("item_id")).agg(
        F.min("owner_rank").alias("best"), F.count(F.lit(1)).alias("named"))
    return _ranked(named, "chunk", [F.col("best"), -F.col("named"), F.col("item_id")], k)


def mode_local(entity_hits: DataFrame, edges: DataFrame, sources: DataFrame, k: int = TOP_K) -> DataFrame:
    """Entities near the question, their edges, and the chunks both come from.

    entity_hits(query_id, case_id, item_id, rank); sources(case_id, owner_id, chunk_id) of nodes and edges.
    """
    ends = edges.select("case_id", "edge_id", F.explode(F.array_distinct(F.array("src_id", "tgt_id"))).alias("item_id"))
    incident = entity_hits.join(ends, ["case_id", "item_id"]).groupBy("query_id", "case_id", F.col("edge_id").alias("item_id")).agg(F.min("rank").alias("best"))
    relations = _ranked(incident, "relation", [F.col("best"), F.col("item_id")], k)
    entities = entity_hits.select("query_id", "case_id", F.lit("entity").alias("kind"), "item_id", "rank")
    owners = entities.unionByName(relations).select("query_id", "case_id", F.col("item_id").alias("owner_id"), F.col("rank").alias("owner_rank"))
    return entities.unionByName(relations).unionByName(_chunks_of(owners, sources, k))


def mode_global(relation_hits: DataFrame, edges: DataFrame, sources: DataFrame, k: int = TOP_K) -> DataFrame:
    """Relations near the question, their ends, and the chunks both come from."""
    ends = edges.select("case_id", F.col("edge_id").alias("item_id"), F.explode(F.array_distinct(F.array("src_id", "tgt_id"))).alias("node_id"))
    touched = relation_hits.join(ends, ["case_id", "item_id"]).groupBy("query_id", "case_id", F.col("node_id").alias("item_id")).agg(F.min("rank").alias("best"))
    entities = _ranked(touched, "entity", [F.col("best"), F.col("item_id")], k)
    relations = relation_hits.select("query_id", "case_id", F.lit("relation").alias("kind"), "item_id", "rank")
    owners = entities.unionByName(relations).select("query_id", "case_id", F.col("item_id").alias("owner_id"), F.col("rank").alias("owner_rank"))
    return entities.unionByName(relations).unionByName(_chunks_of(owners, sources, k))


def interleave(*lists: DataFrame, k: int | None = None) -> DataFrame:
    """Ranked lists merged place by place (first list first), each item at its best place; the first k of each kind, or all."""
    n = len(lists)
    placed = [l.withColumn("place", (F.col("rank") - 1) * n + i) for i, l in enumerate(lists)]
    merged = placed[0]
    for other in placed[1:]:
        merged = merged.unionByName(other)
    best = merged.groupBy("query_id", "case_id", "kind", "item_id").agg(F.min("place").alias("place"))
    keys, order = ["query_id", "case_id", "kind"], ["place", "item_id"]
    ranked = number_rows(best, keys, order, "rank") if k is None else top_per_key(best, keys, [F.col(c) for c in order], k)
    return ranked.drop("place")


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """New order by relevance score; items without one keep 1 - 0.01 per place."""
    scored = hits.join(scores.select("query_id", "item_id", F.col("score").alias("_new")), ["query_id", "item_id"], "left")
    scored = scored.withColumn("score", F.coalesce("_new", 1.0 - (F.col("rank") - 1) * 0.01)).withColumnRenamed("rank", "old_rank")
    ordered = scored.drop("_new").withColumn("_down", -F.col("score"))
    return number_rows(ordered, ["query_id"], ["_down", "old_rank", "item_id"], "rank").drop("_down")


def _path_keys(path: Column) -> Column:
    lowered = F.lower(strip(F.translate(path, "\\", "/")))
    parts = F.filter(F.split(lowered, "/"), lambda p: p != "")
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), lowered)
    return F.filter(F.array_distinct(F.array(lowered, base)), lambda k: k != "")


def document_paths(documents: DataFrame) -> DataFrame:
    """(case_id, key, stored_file_path): path or name -> the first document that answers to it."""
    keys = F.array_distinct(F.concat(_path_keys(F.col("stored_file_path")), _path_keys(F.coalesce("original_filename", F.lit("")))))
    return documents.select("case_id", "stored_file_path", "created_ord", F.explode(keys).alias("key")).groupBy("case_id", "key").agg(
        F.min_by("stored_file_path", "created_ord").alias("resolved_path"))


def resolve_paths(rows: DataFrame, documents: DataFrame, key: list[str]) -> DataFrame:
    """Adds resolved_path for the first candidate of a packed file_path that names a document; others drop out."""
    parts = F.filter(F.transform(F.split("file_path", LIST_SEPARATOR), strip), lambda p: p != "")
    candidates = rows.select("case_id", *key, F.posexplode(parts).alias("part_no", "part")).select("case_id", *key, "part_no", F.posexplode(_path_keys(F.col("part"))).alias("key_pos", "key"))
    best = candidates.join(document_paths(documents), ["case_id", "key"]).groupBy("case_id", *key).agg(
        F.min_by("resolved_path", F.struct("part_no", "key_pos")).alias("resolved_path"))
    return rows.join(best, ["case_id", *key])


def normalise_references(references: DataFrame, documents: DataFrame) -> DataFrame:
    """references(query_id, case_id, pos, reference_id, file_path) -> distinct (reference_id, file_path) in order."""
    named = references.filter((strip(F.col("reference_id")) != "") & (strip(F.col("file_path")) != ""))
    found = resolve_paths(named, documents, ["query_id", "pos"])
    return found.groupBy("query_id", "case_id", strip(F.col("reference_id")).alias("reference_id"), F.col("resolved_path").alias("file_path")).agg(F.min("pos").alias("pos"))


def normalise_chunks(chunks: DataFrame, references: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with a resolved path and a reference id (their own, else that of the path), each snippet once."""
    found = resolve_paths(chunks.filter(strip(F.col("file_path")) != ""), documents, ["query_id", "pos"])
    by_path = references.groupBy("query_id", "case_id", F.col("file_path").alias("resolved_path")).agg(F.max_by("reference_id", "pos").alias("_path_reference"))
    filled = found.join(by_path, ["query_id", "case_id", "resolved_path"], "left").withColumn(
        "reference_id", F.coalesce(pick_text(F.col("reference_id")), "_path_reference")).filter(F.col("reference_id").isNotNull())
    snippet = clip(strip(F.coalesce("content", F.lit(""))), CHUNK_SNIPPET)
    return filled.groupBy("query_id", "case_id", "reference_id", F.col("resolved_path").alias("file_path"), snippet.alias("snippet")).agg(
        F.min("pos").alias("pos"), F.min_by("content", "pos").alias("full_text"))


def _field(df: DataFrame, *names: str) -> Column:
    present = [F.col(n) for n in names if n in df.columns]
    return pick_text(*present) if present else F.lit(None).cast("string")


def entity_records(raw: DataFrame) -> DataFrame:
    """raw(query_id, pos, alias columns...) -> distinct (query_id, pos, id, type)."""
    rows = raw.select("query_id", "pos", _field(raw, "entity_id", "id", "node_id", "entity_name", "name", "label").alias("id"),
                      F.lower(F.coalesce(_field(raw, "entity_type", "type", "node_type", "category"), F.lit(""))).alias("type"))
    return rows.filter(F.col("id").isNotNull()).groupBy("query_id", "id").agg(F.min_by("type", "pos").alias("type"), F.min("pos").alias("pos"))


def relation_records(raw: DataFrame) -> DataFrame:
    """raw(query_id, pos, alias columns...) -> distinct (query_id, pos, id, type, src_id, tgt_id)."""
    src, tgt = _field(raw, "src_id", "source", "source_id", "from"), _field(raw, "tgt_id", "target", "target_id", "to")
    keyword = F.upper(strip(F.split(_field(raw, "keywords"), ",")[0]))
    named = F.upper(_field(raw, "relation_type", "rel_type", "type", "predicate", "label"))
    typed = raw.select("query_id", "pos", src.alias("src_id"), tgt.alias("tgt_id"), _field(raw, "id", "edge_id", "relationship_id").alias("id"),
                       F.nullif(F.when(keyword.isNotNull(), keyword).otherwise(named), F.lit("")).alias("type"))
    composed = F.when(F.col("src_id").isNotNull() & F.col("tgt_id").isNotNull(), F.concat_ws("__", "src_id", F.coalesce("type", F.lit("REL")), "tgt_id"))
    keyed = typed.withColumn("id", F.coalesce("id", composed)).filter(F.col("id").isNotNull())
    parts = F.split("id", "__")
    from_id = F.when(F.size(parts) >= 3, F.nullif(F.upper(strip(F.try_element_at(parts, F.lit(-2)))), F.lit("")))
    full = F.struct(F.coalesce("type", from_id, F.lit("REL")).alias("type"), F.coalesce("src_id", F.lit("")).alias("src_id"), F.coalesce("tgt_id", F.lit("")).alias("tgt_id"))
    return keyed.groupBy("query_id", "id").agg(F.min_by(full, "pos").alias("r"), F.min("pos").alias("pos")).select("query_id", "pos", "id", "r.*")


def normalise_top_k(raw: Column) -> Column:
    """Number of rows to report: 5 when missing, unreadable or not positive, at most 100."""
    value = F.floor(strip(raw.cast("string")).try_cast("double"))
    return F.when(value > MAX_TOP_K, MAX_TOP_K).when(value > 0, value).otherwise(EVAL_TOP_K).cast("int")


def retrieval_report(queries: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """queries(query_id, mode, top_k) -> first ids and types and the presence flags of each question."""
    asked = queries.withColumn("top_k", normalise_top_k(F.col("top_k")))

    def first(records: DataFrame, name: str, case) -> DataFrame:
        ranked = top_per_key(records, ["query_id"], [F.col("pos"), F.col("id")], MAX_TOP_K).join(asked.select("query_id", "top_k"), "query_id").filter(F.col("rank") <= F.col("top_k"))
        listed = F.array_sort(F.collect_list(F.struct("rank", "id", "type")))
        return ranked.groupBy("query_id").agg(
            F.array_join(F.transform(listed, lambda s: s["id"]), ",").alias(f"{name}_ids"),
            F.array_join(F.filter(F.transform(listed, lambda s: case(s["type"])), lambda t: t != ""), ",").alias(f"{name}_types"))

    out = asked.join(first(entities, "entity", F.lower), "query_id", "left").join(first(relations, "relation", F.upper), "query_id", "left")
    out = out.fillna("", ["entity_ids", "entity_types", "relation_ids", "relation_types"])
    return out.withColumn("entities_present", F.col("entity_ids") != "").withColumn("relations_present", F.col("relation_ids") != "").withColumn(
        "non_empty_payload", F.col("entities_present") | F.col("relations_present"))


def insufficient_evidence(queries: DataFrame, *retrieved: DataFrame) -> DataFrame:
    """Flags the questions for which nothing at all was retrieved: no entity, no relation, no chunk, whichever are given."""
    found = retrieved[0].select("query_id")
    for more in retrieved[1:]:
        found = found.unionByName(more.select("query_id"))
    some = found.distinct().withColumn("_some", F.lit(True))
    return queries.join(some, "query_id", "left").select(*queries.columns, F.col("_some").isNull().alias("insufficient_evidence"))
