"""Filtered graph views, searches, counts and detail rows over the consolidated graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.functions.text import clean_description
from caseloom.functions.vocabulary import ENTITY_TYPES, FALLBACK_RELATION, entity_subtype, normalise_entity_type
from caseloom.operators.consolidate import edge_id
from caseloom.operators.traverse import induced_edges, khop_nodes
from caseloom.session import cut_lineage, number_rows, top_per_key

NODE_KEY = ["case_id", "node_id"]

# How many rows the reports keep.
DEFAULT_VIEW_LIMIT = 1000
SEARCH_LIMIT = 25
ACTOR_COUNT_LIMIT = 300
TOP_TYPES, TOP_ENTITIES, TOP_RELATIONS, RELATED_LIMIT, LEGEND_EDGE_LIMIT = 6, 15, 10, 6, 12
HIGHLIGHT_NODE_CAP, HIGHLIGHT_EDGE_CAP, FALLBACK_NODES, FALLBACK_EDGES = 60, 80, 25, 40


def _any_of(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def in_date_window(timestamp: Column, date_from: str | None, date_to: str | None) -> Column:
    """Undated and unreadable timestamps pass."""
    date = F.when(timestamp.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(timestamp, 1, 10), "yyyy-MM-dd"))
    inside = F.lit(True)
    if date_from:
        inside = inside & (date >= F.lit(date_from).cast("date"))
    if date_to:
        inside = inside & (date <= F.lit(date_to).cast("date"))
    return date.isNull() | inside


def filter_edges(
    edges: DataFrame, *, keywords: list[str] | None = None, relation_types: list[str] | None = None,
    min_confidence: float | None = None, date_from: str | None = None, date_to: str | None = None,
) -> DataFrame:
    """The edge filters of a view; an unknown confidence fails a threshold."""
    if keywords:
        edges = edges.filter(_any_of(F.lower(F.concat_ws(" ", "relation_type", "label")), keywords))
    if relation_types:
        edges = edges.filter(F.upper("relation_type").isin([t.strip().upper() for t in relation_types if t.strip()]))
    if min_confidence is not None:
        edges = edges.filter(F.col("confidence_score") >= min_confidence)
    if date_from or date_to:
        edges = edges.filter(in_date_window(F.col("timestamp"), date_from, date_to))
    return edges


def both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("case_id", "node_id")
    kept = edges.join(ids.withColumnRenamed("node_id", "src_id"), ["case_id", "src_id"], "left_semi")
    return kept.join(ids.withColumnRenamed("node_id", "tgt_id"), ["case_id", "tgt_id"], "left_semi")


def focus_on(nodes: DataFrame, edges: DataFrame, focus: str, hops: int) -> tuple[DataFrame, DataFrame]:
    """Neighbourhood of the focus in cases that hold it; other cases stay as they are."""
    seeds = nodes.filter(F.col("node_id") == focus).select(*NODE_KEY)
    near = khop_nodes(edges, seeds, hops)
    others = nodes.join(seeds.select("case_id"), "case_id", "left_anti")
    kept = nodes.join(near.select(*NODE_KEY), NODE_KEY, "left_semi").unionByName(others)
    return kept, both_ends(edges, kept)


def graph_view(
    nodes: DataFrame, edges: DataFrame, *, limit: int | None = DEFAULT_VIEW_LIMIT, entity_types: list[str] | None = None,
    focus: str | None = None, max_hops: int = 1, **edge_filters,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with rank, edges, truncated flag per case): edge filters, types, focus, then the limit.

    Degrees stay those of the whole graph. With limit None all nodes are shown and none is ranked.
    """
    edges = filter_edges(edges, **edge_filters)
    if entity_types:
        nodes = nodes.filter(F.lower("entity_type").isin([t.lower() for t in entity_types]))
    if focus:
        if entity_types:  # paths go through nodes of these types only; without a focus one look at both ends, below, is enough
            edges = both_ends(edges, nodes)
        nodes, edges = focus_on(nodes, edges, focus, max(0, max_hops))
    if limit is None:
        return nodes.withColumn("rank", F.lit(None).cast("long")), both_ends(edges, nodes), nodes.select("case_id", F.lit(False).alias("truncated")).distinct()
    first = F.when(F.col("node_id") == F.lit(focus), 0).otherwise(1)
    order = [-F.col("degree"), F.lower("label"), F.lower("node_id"), F.col("node_id")]
    shown = top_per_key(nodes, ["case_id"], [first, *order], max(1, limit))
    truncated = nodes.groupBy("case_id").agg((F.count(F.lit(1)) > max(1, limit)).alias("truncated"))
    return shown, both_ends(edges, shown), truncated


def describe_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as a view shows them: subtype tag and cleaned summary."""
    return nodes.withColumn("entity_subtype", entity_subtype(F.col("entity_type"))).withColumn(
        "summary", clean_description(F.col("summary"), F.col("label"))
    )


def _search(nodes: DataFrame, query: str, prefix_of: list[Column], order: list[Column], limit: int) -> DataFrame:
    needle = query.strip().lower()
    hay = F.lower(F.concat_ws(" ", "label", "node_id"))
    starts = F.lit(False)
    for c in prefix_of:
        starts = starts | F.lower(c).startswith(needle)
    hits = nodes.filter(hay.contains(needle) & F.lit(needle != ""))
    keys = [F.when(starts, 0).otherwise(1), F.instr(hay, needle), *order, F.lower("label"), F.col("node_id")]
    return top_per_key(hits, ["case_id"], keys, limit).select("case_id", "rank", "node_id", "label", "entity_type")


def search_nodes(nodes: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Substring search; hits at the start of label or id first, then by position and degree."""
    return _search(nodes, query, [F.col("label"), F.col("node_id")], [-F.col("degree")], limit)


def search_actors(nodes: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    return _search(nodes, query, [F.concat_ws(" ", "label", "node_id")], [], limit)


def _listed(categories=None, keyword=None, include_undated=True, year_min=None, year_max=None) -> Column:
    """Whether an edge passes the filters of a listing."""
    passes, dated = F.lit(True), F.col("timestamp").isNotNull() & (F.col("timestamp") != "")
    if categories:
        passes = passes & F.upper("relation_type").isin([c.upper() for c in categories])
    if keyword and keyword.strip():
        text = F.lower(F.concat(F.col("relation_type"), F.lit(" "), F.col("label"), F.lit(" "), F.coalesce("raw_phrase", F.lit(""))))
        passes = passes & text.contains(keyword.strip().lower())
    if not include_undated:
        passes = passes & dated
    year = F.expr("try_cast(split(timestamp, '-')[0] as int)")
    if year_min:
        passes = passes & (~dated | year.isNull() | (year >= year_min))
    if year_max:
        passes = passes & (~dated | year.isNull() | (year <= year_max))
    return passes


def actor_scope(nodes: DataFrame, edges: DataFrame, actor: str | None, max_hops: int) -> DataFrame:
    """Edges near the actor in cases that know it, all edges of the other cases."""
    if not actor:
        return edges
    # written out, so that the few cases with the actor are known to be few and edges are not shuffled by case
    seeds = cut_lineage(nodes.filter((F.col("label") == actor) | (F.col("node_id") == actor)).select(*NODE_KEY))
    near = khop_nodes(edges, seeds, max(0, max_hops))
    untouched = edges.join(seeds.select("case_id").distinct(), "case_id", "left_anti")
    return induced_edges(edges, near).select(*edges.columns).unionByName(untouched)


def relationship_counts(nodes: DataFrame, edges: DataFrame, *, actor=None, max_hops: int = 0, **filters) -> DataFrame:
    """One row per case: its nodes and edges, the edges in scope and those of them that are listed, both counted in one pass."""
    n = F.count(F.lit(1))
    within = actor_scope(nodes, edges, actor, max_hops).groupBy("case_id").agg(n.alias("total_before_filter"), F.count_if(_listed(**filters)).alias("total_before_limit"))
    counts = nodes.groupBy("case_id").agg(n.alias("node_count"))
    counts = counts.join(edges.groupBy("case_id").agg(n.alias("edge_count")), "case_id", "left").join(within, "case_id", "left")
    return counts.fillna(0, ["edge_count", "total_before_filter", "total_before_limit"]).withColumn("projection_empty", F.lit(False))


def relationships(
    nodes: DataFrame, edges: DataFrame, details: DataFrame | None = None, evidence: DataFrame | None = None, *, limit: int,
    actor=None, max_hops: int = 0, **filters,
) -> DataFrame:
    """Ranked relationship rows."""
    kept = actor_scope(nodes, edges, actor, max_hops).filter(_listed(**filters))
    # a few rows per case, written out so that nodes need not be shuffled to meet them
    listed = cut_lineage(top_per_key(kept, ["case_id"], [F.col("edge_id")], max(1, limit)))
    named = listed.select("case_id", F.explode(F.array("src_id", "tgt_id")).alias("node_id"))
    ends = nodes.select("case_id", "node_id", "label", "entity_type", "summary").join(named, NODE_KEY, "left_semi")

    def side(prefix: str, key: str) -> DataFrame:
        return ends.select("case_id", F.col("node_id").alias(key), F.col("label").alias(f"{prefix}_label"),
                           F.col("entity_type").alias(f"{prefix}_type"), F.col("summary").alias(f"{prefix}_summary"))

    rows = listed.join(side("actor", "src_id"), ["case_id", "src_id"], "left").join(side("target", "tgt_id"), ["case_id", "tgt_id"], "left")
    phrase = F.concat(F.coalesce("actor_label", "src_id"), F.lit(" "), F.lower(F.translate("relation_type", "_", " ")),
                      F.lit(" "), F.coalesce("target_label", "tgt_id"), F.lit("."))
    described = [F.when(F.col("label") != "", F.col("label")), phrase]
    if details is not None:
        rows = rows.join(details.select("case_id", "src_id", "tgt_id", "description"), ["case_id", "src_id", "tgt_id"], "left")
        described.insert(0, F.when(F.col("description") != "", F.col("description")))
    if evidence is not None:
        at = F.struct("file_path", "reference_id", "document_id")
        first = evidence.filter(F.col("owner_kind") == "edge").groupBy("case_id", F.col("owner_key").alias("edge_id")).agg(
            F.min_by("document_id", F.when(F.col("document_id").isNotNull(), at)).alias("document_id"),
            F.min_by("reference_id", at).alias("source_id"),
        )
        rows = rows.join(first, ["case_id", "edge_id"], "left")
    keep = [c for c in ("document_id", "source_id") if c in rows.columns]
    return rows.select(
        "case_id", "rank", "edge_id", "timestamp", F.col("src_id").alias("actor_id"),
        F.coalesce("actor_label", "src_id").alias("actor"), F.coalesce("actor_type", F.lit("other")).alias("actor_type"),
        F.col("relation_type").alias("action"), F.coalesce(*described).alias("description"),
        F.col("tgt_id").alias("target_id"), F.coalesce("target_label", "tgt_id").alias("target"),
        F.coalesce("target_type", F.lit("other")).alias("target_type"), "actor_summary", "target_summary", *keep,
    )


def actor_stats(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Totals and edges per relation type as (case_id, measure, name, n) rows."""
    n = F.count(F.lit(1)).alias("n")

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(n).select("case_id", F.lit("total").alias("measure"), F.lit(name).alias("name"), "n")

    per_type = edges.groupBy("case_id", F.col("relation_type").alias("name")).agg(n)
    return (
        total(documents, "documents").unionByName(total(edges, "relationships")).unionByName(total(nodes, "actors"))
        .unionByName(per_type.select("case_id", F.lit("category").alias("measure"), "name", "n"))
    )


def tag_clusters(edges: DataFrame) -> DataFrame:
    """Relation types of a case by name with a running id from 0."""
    per_type = edges.groupBy("case_id", F.col("relation_type").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    ranked = number_rows(per_type, ["case_id"], ["name"], "cluster_id")
    return ranked.withColumn("cluster_id", F.col("cluster_id") - 1)


def actor_counts(nodes: DataFrame, limit: int = ACTOR_COUNT_LIMIT) -> DataFrame:
    ranked = top_per_key(nodes, ["case_id"], [-F.col("degree"), F.col("node_id")], max(1, limit))
    return ranked.select("case_id", "rank", "node_id", "label", "degree")


def actor_count(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Degree of the wanted (case_id, node_id) rows; unknown ones count zero."""
    return wanted.join(nodes.select(*NODE_KEY, "degree"), NODE_KEY, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def case_metrics(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity and relationship counts per case, the six most frequent types per case)."""
    n = F.count(F.lit(1))
    totals = nodes.groupBy("case_id").agg(n.alias("entity_count")).join(
        edges.groupBy("case_id").agg(n.alias("relationship_count")), "case_id", "full"
    ).select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entity_count", "relationship_count")])
    types = nodes.groupBy("case_id", normalise_entity_type(F.col("entity_type")).alias("entity_type")).agg(n.alias("count"))
    return totals, top_per_key(types, ["case_id"], [-F.col("count"), F.col("entity_type")], TOP_TYPES)


def summary_context(nodes: DataFrame, edges: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Top entities, top relation types and the figures of each case."""
    order = [-F.col("degree"), F.lower("label"), F.col("node_id")]
    entities = top_per_key(nodes, ["case_id"], order, TOP_ENTITIES).select(
        "case_id", "rank", F.col("label").alias("name"), F.coalesce("entity_type", F.lit("other")).alias("type"),
        F.col("degree").alias("connections"), F.substring(F.coalesce("summary", F.lit("")), 1, 200).alias("summary"),
    )
    per_type = edges.groupBy("case_id", F.col("relation_type").alias("type")).agg(F.count(F.lit(1)).alias("count"))
    relations = top_per_key(per_type, ["case_id"], [-F.col("count"), F.col("type")], TOP_RELATIONS)
    stamp = F.when(F.col("timestamp") != "", F.col("timestamp"))
    counted = [F.count_if(F.lower("entity_type") == t).alias(f"{t}_count") for t in ENTITY_TYPES if t != "organization"]
    figures = (
        nodes.groupBy("case_id").agg(*counted)
        .join(edges.groupBy("case_id").agg(F.min(stamp).alias("earliest"), F.max(stamp).alias("latest")), "case_id", "left")
        .join(documents.groupBy("case_id").agg(F.count(F.lit(1)).alias("document_count")), "case_id", "left")
        .withColumn("document_count", F.coalesce("document_count", F.lit(0)))
    )
    return {"entities": entities, "relations": relations, "figures": figures}


def related_entities(nodes: DataFrame, edges: DataFrame, limit: int = RELATED_LIMIT) -> DataFrame:
    """Up to six neighbours per entity by relation type and label.

    An edge id that follows from the edge's ends and type does not travel with it: rows are narrowed down by type and label, and the id is
    worked out again where rows that tie in both have met.
    """
    usual = edge_id(F.col("src_id"), F.col("tgt_id"), F.col("relation_type"))
    other_id = F.when(~F.col("edge_id").eqNullSafe(usual), F.struct("edge_id")).alias("_id")
    slim = edges.select("case_id", "src_id", "tgt_id", "relation_type", F.col("label").alias("description"), other_id)
    carried = ["case_id", "relation_type", "description", "_id"]
    links = slim.select(*carried, F.col("src_id").alias("entity_id"), F.col("tgt_id").alias("node_id"), F.lit(True).alias("_out"))
    reverse = slim.filter(F.col("src_id") != F.col("tgt_id")).select(*carried, F.col("tgt_id").alias("entity_id"), F.col("src_id").alias("node_id"), F.lit(False).alias("_out"))
    others = nodes.select(*NODE_KEY, "label", "entity_type")
    adjacent = links.unionByName(reverse).join(others, NODE_KEY, "left").select(
        "case_id", "entity_id", F.col("node_id").alias("other_id"), F.coalesce("label", "node_id").alias("other_label"),
        F.coalesce("entity_type", F.lit("other")).alias("other_type"), "relation_type", "description", "_id", "_out",
    )
    entity, by_name = ["case_id", "entity_id"], [F.col("relation_type"), F.lower("other_label")]
    near = adjacent.withColumn("_at", F.rank().over(Window.partitionBy(*entity).orderBy(*by_name))).filter(F.col("_at") <= limit)
    ends = [F.when(F.col("_out"), F.col(a)).otherwise(F.col(b)) for a, b in (("entity_id", "other_id"), ("other_id", "entity_id"))]
    known = near.select(
        *entity, "other_id", "other_label", "other_type", "relation_type", "description",
        F.when(F.col("_id").isNotNull(), F.col("_id.edge_id")).otherwise(edge_id(*ends, F.col("relation_type"))).alias("edge_id"),
    )
    return top_per_key(known, entity, [*by_name, F.col("edge_id"), F.col("other_id")], limit)


def first_snippet(evidence: DataFrame, kind: str) -> DataFrame:
    """First snippet per owner in evidence order."""
    at = F.struct("file_path", "reference_id", "document_id")
    return (
        evidence.filter((F.col("owner_kind") == kind) & F.col("snippet").isNotNull())
        .groupBy("case_id", "owner_key").agg(F.min_by("snippet", at).alias("snippet"))
    )


def entity_details(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per entity with the composed description."""
    related = related_entities(nodes, edges).groupBy("case_id", F.col("entity_id").alias("node_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "other_label"))), lambda s: s["other_label"]).alias("linked")
    )
    snippets = first_snippet(evidence, "entity").withColumnRenamed("owner_key", "node_id")
    cleaned = clean_description(F.col("summary"), F.col("label"))
    stock = F.concat("label", F.lit(" is represented as a "), F.lower("entity_type"), F.lit(" entity in this case graph."))
    names = F.filter("linked", lambda l: l != "")
    linked = F.when(
        F.size(names) > 0,
        F.concat(F.lit("It is linked to "), F.array_join(F.slice(names, 1, 3), ", "),
                 F.when(F.size(names) > 3, " and others.").otherwise(".")),
    )
    backed = F.when(F.col("snippet") != "", F.concat(F.lit("Supporting evidence mentions: "), F.col("snippet")))
    return nodes.join(related, NODE_KEY, "left").join(snippets, NODE_KEY, "left").select(
        *NODE_KEY, "label", "entity_type", "degree", F.col("summary").alias("raw_description"),
        F.concat_ws(" ", F.coalesce(cleaned, stock), linked, backed).alias("description"),
    )


def relationship_details(nodes: DataFrame, details: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row per directed pair with the composed description; evidence has owner_kind "pair", owner_key "src|tgt".

    Without evidence, details have their first snippet with them. Labels are looked up only for pairs without a description of their own.
    """
    if evidence is not None:
        keyed = details.withColumn("owner_key", F.concat_ws("|", "src_id", "tgt_id"))
        details = keyed.join(first_snippet(evidence, "pair"), ["case_id", "owner_key"], "left").drop("owner_key")
    own = clean_description(F.col("description"), F.lit(None).cast("string"))
    written = cut_lineage(details.withColumn("_own", own))
    rows, bare = (written.filter(c).withColumns({"_src": F.lit(None).cast("string"), "_tgt": F.lit(None).cast("string")}) for c in ("_own is not null", "_own is null"))
    if not bare.isEmpty():
        labels = nodes.select("case_id", "node_id", "label")
        rows = rows.unionByName(
            bare.drop("_src", "_tgt")
            .join(labels.select("case_id", F.col("node_id").alias("src_id"), F.col("label").alias("_src")), ["case_id", "src_id"], "left")
            .join(labels.select("case_id", F.col("node_id").alias("tgt_id"), F.col("label").alias("_tgt")), ["case_id", "tgt_id"], "left"))
    relation = F.coalesce(F.try_element_at("relation_types", F.lit(1)), F.lit(FALLBACK_RELATION))
    stock = F.concat(F.coalesce("_src", "src_id"), F.lit(" is linked to "), F.coalesce("_tgt", "tgt_id"), F.lit(" through "), relation, F.lit("."))
    base = F.coalesce("_own", stock)
    return rows.select(
        "case_id", "src_id", "tgt_id", relation.alias("relation_type"), F.array_join("relation_types", ",").alias("relation_types"),
        "raw_phrase", "confidence_score", "confidence_band", F.col("description").alias("raw_description"),
        F.when(F.col("snippet") != "", F.concat(base, F.lit(" Supporting evidence mentions: "), F.col("snippet"))).otherwise(base).alias("description"),
    )


def highlight_entities(retrieved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Retrieved (query_id, case_id, pos, node_id) that exist in the graph, each once."""
    known = retrieved.join(nodes.select(*NODE_KEY), NODE_KEY, "left_semi")
    return known.groupBy("query_id", *NODE_KEY).agg(F.min("pos").alias("pos"))


def highlight_relations(retrieved: DataFrame, edges: DataFrame) -> DataFrame:
    """Retrieved (query_id, case_id, pos, src_id, tgt_id, type) matched to an edge in either direction."""
    low, high = F.least("src_id", "tgt_id").alias("low"), F.greatest("src_id", "tgt_id").alias("high")
    by_pair = edges.groupBy("case_id", low, high).agg(
        F.max_by(F.struct(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"), F.col("edge_id").alias("id")), "edge_id").alias("edge")
    )
    hit = retrieved.select("query_id", "case_id", "pos", low, high, "type").join(by_pair, ["case_id", "low", "high"])
    return hit.groupBy(
        "query_id", "case_id", F.col("edge.src").alias("src_id"), F.col("edge.tgt").alias("tgt_id"), F.col("edge.id").alias("edge_id")
    ).agg(F.min_by("type", "pos").alias("relation_type"), F.min("pos").alias("pos"))


def highlight_subgraph(nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per query (all of one case): matched edges and nodes under their caps, else the best connected part.

    entities(query_id, case_id, name); relations(query_id, case_id, src_id, tgt_id, edge_id).
    """
    query = ["query_id", "case_id"]
    # what is asked, what it hits and the stand-ins are written out once each: spelled out at every use, they made a plan of 80 exchanges,
    # and keeping that took more of the driver than the rows
    named, related = cut_lineage(entities.select(*query, "name")), cut_lineage(relations.select(*query, "src_id", "tgt_id", "edge_id"))
    # the case's stand-in for questions that hit nothing
    order = [-F.col("degree"), F.lower("label"), F.lower("node_id"), F.col("node_id")]
    slim = nodes.select(*NODE_KEY, "label", "degree")
    best = cut_lineage(top_per_key(slim, ["case_id"], order, FALLBACK_NODES))
    best_edges = top_per_key(both_ends(edges, best), ["case_id"], [F.col("edge_id")], FALLBACK_EDGES)
    found, hit = edges.select("case_id", "src_id", "tgt_id", "edge_id"), [*query, "edge_id", "src_id", "tgt_id"]
    hits = related.select(*query, "src_id", "tgt_id").join(found, ["case_id", "src_id", "tgt_id"]).select(*hit)
    by_id = related.filter(F.col("edge_id").isNotNull()).select(*query, "edge_id")
    if not by_id.isEmpty():  # only then are the edges dealt out by their ids as well
        hits = hits.unionByName(by_id.join(found, ["case_id", "edge_id"]).select(*hit))
    hit_edges = cut_lineage(hits.distinct())
    ends = hit_edges.select(*query, "src_id", "tgt_id").unionByName(related.select(*query, "src_id", "tgt_id"))
    names = named.unionByName(ends.select(*query, F.explode(F.array("src_id", "tgt_id")).alias("name"))).filter(F.col("name") != "").distinct()
    called = slim.withColumn("name", F.explode(F.array_distinct(F.array("node_id", "label"))))
    hit_nodes = cut_lineage(names.join(called, ["case_id", "name"]).select("query_id", *NODE_KEY, "label", "degree").distinct())
    asked = named.select(*query).unionByName(related.select(*query)).distinct()
    answered = hit_nodes.select(*query).unionByName(hit_edges.select(*query)).distinct()
    empty = asked.join(answered, query, "left_anti")
    all_nodes = top_per_key(hit_nodes, query, order, HIGHLIGHT_NODE_CAP).unionByName(
        empty.join(best, "case_id").select("query_id", *NODE_KEY, "label", "degree", "rank"))
    all_edges = top_per_key(hit_edges, query, [F.col("edge_id")], HIGHLIGHT_EDGE_CAP).unionByName(
        empty.join(best_edges.select("case_id", "edge_id", "src_id", "tgt_id", "rank"), "case_id").select("query_id", "case_id", "edge_id", "src_id", "tgt_id", "rank"))
    return all_nodes, all_edges


def legend_nodes(nodes: DataFrame) -> DataFrame:
    kind = normalise_entity_type(F.col("entity_type"))
    return nodes.groupBy("case_id", kind.alias("entity_type")).agg(F.count(F.lit(1)).alias("count"))


def legend_edges(edges: DataFrame, limit: int = LEGEND_EDGE_LIMIT) -> DataFrame:
    name = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ("relation_type", "label")], F.lit(FALLBACK_RELATION))
    per_type = edges.groupBy("case_id", name.alias("relation_type")).agg(F.count(F.lit(1)).alias("count"))
    return top_per_key(per_type, ["case_id"], [-F.col("count"), F.col("relation_type")], limit)


def view_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree inside the view rather than in the whole graph."""
    from caseloom.operators.consolidate import with_degree

    return with_degree(nodes.drop("degree"), edges)


def relation_type_options(edges: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """Distinct relation types of a view and the chosen filters."""
    seen = edges.select(F.trim("relation_type").alias("relation_type")).filter(F.col("relation_type") != "")
    if chosen:
        seen = seen.unionByName(seen.sparkSession.createDataFrame([(c,) for c in chosen], "relation_type string"))
    return seen.distinct()


def selection_evidence(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence of every node: its own, and only where it has none that of its relationships."""
    facts = [c for c in ("file_path", "reference_id", "document_id", "source_id", "confidence_code") if c in evidence.columns]
    own = evidence.filter(F.col("owner_kind") == "entity").select("case_id", F.col("owner_key").alias("node_id"), *facts)
    ends = edges.select("case_id", "edge_id", F.explode(F.array_distinct(F.array("src_id", "tgt_id"))).alias("node_id"))
    lacking = ends.join(own.select(*NODE_KEY).distinct(), NODE_KEY, "left_anti")
    behind = evidence.filter(F.col("owner_kind") == "edge").select("case_id", F.col("owner_key").alias("edge_id"), *facts)
    return own.unionByName(lacking.join(behind, ["case_id", "edge_id"]).select(*NODE_KEY, *facts)).distinct()
