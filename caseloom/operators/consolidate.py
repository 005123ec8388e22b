"""Raw node and relation records -> consolidated nodes, edges, pair details and degrees.

Records carry case_id, source_ord and row_ord: "the first record wins" is decided by that pair, never
by arrival order. Any of the alias columns may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import (
    blank_to_null, clean_stripped, first_date, pick_text, prefixed_type, relation_label, relation_type_text,
    split_packed, strip, usable_summary, without_type,
)
from caseloom.functions.vocabulary import FALLBACK_RELATION, normalise_entity_type, normalise_relation

def seen_at() -> Column:
    return F.struct("source_ord", "row_ord")


def field(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _pick(df: DataFrame, *names: str) -> Column:
    present = [F.col(n) for n in names if n in df.columns]
    return pick_text(*present) if present else F.lit(None).cast("string")


def _first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), seen_at()))


def edge_id(src: Column, tgt: Column, relation: Column) -> Column:
    return F.concat(F.lit("edge-"), F.substring(F.sha1(F.concat_ws("|", src, tgt, relation).cast("binary")), 1, 16))


def node_records(records: DataFrame) -> DataFrame:
    """One typed row per raw node record that names a node."""
    # staged, so that no expression is spelled out twice in the plan
    picked = records.select(
        "case_id", "source_ord", "row_ord",
        _pick(records, "entity_name", "id", "node_id", "label", "name").alias("node_id"),
        _pick(records, "label", "entity_name", "name").alias("_label"),
        _pick(records, "entity_type", "type").alias("_type"),
        usable_summary(field(records, "description"), field(records, "summary"), field(records, "content")).alias("_summary"),
    ).filter(F.col("node_id").isNotNull())
    labelled = picked.withColumn("_label", F.coalesce("_label", "node_id")).withColumn("label", without_type(F.col("_label")))
    labelled = labelled.withColumns({"_text": strip(F.col("_summary")), "_name": strip(F.col("label"))})
    return labelled.select(
        "case_id", "source_ord", "row_ord", "node_id", "label",
        F.coalesce(prefixed_type(F.col("_label")), normalise_entity_type(F.col("_type"))).alias("entity_type"),
        clean_stripped(F.col("_text"), F.col("_name")).alias("summary"),
    )


def consolidate_nodes(records: DataFrame) -> DataFrame:
    """First type, first label that differs from the id, longest summary."""
    return (
        node_records(records)
        .groupBy("case_id", "node_id")
        .agg(
            F.min_by("label", F.when(F.col("label") != F.col("node_id"), seen_at())).alias("_label"),
            F.min_by("entity_type", seen_at()).alias("entity_type"),
            F.max_by(
                "summary",
                F.when(
                    F.col("summary").isNotNull(),
                    F.struct(F.length("summary"), -F.col("source_ord"), -F.col("row_ord")),
                ),
            ).alias("summary"),
        )
        .select(
            "case_id", "node_id", F.coalesce("_label", "node_id").alias("label"), "entity_type", "summary"
        )
    )


def edge_records(records: DataFrame, words: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One normalised row per raw relation record that names both endpoints; columns named in keep are passed on."""
    src = _pick(records, "src_id", "source", "src", "from")
    tgt = _pick(records, "tgt_id", "target", "tgt", "to")
    content = field(records, "content")
    aliases = {n: field(records, n) for n in ("keywords", "relation_type", "type", "label")}
    wording = relation_type_text(aliases, content)
    stamp = _pick(records, "timestamp", "date", "datetime", "time")
    dated = F.coalesce(first_date(stamp), stamp, first_date(_pick(records, "description", "content")))
    labelled = records.select(
        "case_id", "source_ord", "row_ord",
        src.alias("src_id"), tgt.alias("tgt_id"),
        F.coalesce(wording, F.lit(FALLBACK_RELATION)).alias("_wording"),
        relation_label(_pick(records, "description", "summary"), blank_to_null(content), wording, src, tgt).alias("label"),
        field(records, "keywords").alias("_keywords"),
        (F.expr("try_cast(weight as double)") if "weight" in records.columns else F.lit(None).cast("double")).alias("weight"),
        dated.alias("timestamp"),
        split_packed(field(records, "source_id")).alias("source_ids"), *keep,
    ).filter(F.col("src_id").isNotNull() & F.col("tgt_id").isNotNull())
    typed = labelled.withColumn("_norm", normalise_relation(F.array("_wording", "label", "_keywords"), words))
    return typed.select(
        "case_id", "source_ord", "row_ord",
        edge_id(F.col("src_id"), F.col("tgt_id"), F.col("_norm.relation_type")).alias("edge_id"),
        "src_id", "tgt_id", "label",
        F.col("_norm.relation_type").alias("relation_type"),
        F.col("_norm.raw_phrase").alias("raw_phrase"),
        F.col("_norm.confidence_score").alias("confidence_score"),
        F.col("_norm.confidence_band").alias("confidence_band"),
        "weight", "timestamp", "source_ids", *keep,
    )


def merge_edges(normalised: DataFrame, canonicalize_undirected: bool = False) -> DataFrame:
    """One row per edge id; the first filled value of every column wins."""
    if canonicalize_undirected:
        low, high = F.least("src_id", "tgt_id"), F.greatest("src_id", "tgt_id")
        normalised = normalised.select(
            *[c for c in normalised.columns if c not in ("edge_id", "src_id", "tgt_id")],
            edge_id(low, high, F.col("relation_type")).alias("edge_id"), low.alias("src_id"), high.alias("tgt_id"),
        )
    firsts = ["label", "raw_phrase", "confidence_score", "confidence_band", "weight", "timestamp"]
    return normalised.groupBy("case_id", "edge_id", "src_id", "tgt_id", "relation_type").agg(
        *[_first(F.col(c)).alias(c) for c in firsts]
    )


def edge_sources(normalised: DataFrame) -> DataFrame:
    """Long table of the source ids of an edge with the place each was first seen."""
    exploded = normalised.select(
        "case_id", "edge_id", "source_ord", "row_ord", F.posexplode("source_ids").alias("pos", "source_id")
    )
    return exploded.groupBy("case_id", "edge_id", "source_id").agg(
        F.min(F.struct("source_ord", "row_ord", "pos")).alias("first_seen")
    )


def implicit_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints that no node record names."""
    ends = edges.select("case_id", F.explode(F.array("src_id", "tgt_id")).alias("node_id")).distinct()
    return ends.join(nodes.select("case_id", "node_id"), ["case_id", "node_id"], "left_anti").select(
        "case_id", "node_id", F.col("node_id").alias("label"), F.lit("Other").alias("entity_type"),
        F.lit(None).cast("string").alias("summary"),
    )


def end_counts(edges: DataFrame) -> DataFrame:
    """case_id, node_id, degree: one count per edge end; a self-loop counts twice."""
    ends = edges.select("case_id", F.explode(F.array("src_id", "tgt_id")).alias("node_id"))
    return ends.groupBy("case_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One count per edge end; a self-loop counts twice and lonely nodes keep zero."""
    return nodes.join(end_counts(edges), ["case_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def pair_details(normalised: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per directed pair: longest label, relation types in order seen, first wording, score and band.

    keep names columns that follow from the pair; records that were put together by them stay where they are.
    """
    pair = ["case_id", *keep, "src_id", "tgt_id"]
    per_type = normalised.groupBy(*pair, "relation_type").agg(
        F.min(seen_at()).alias("seen"),
        F.max_by("label", F.struct(F.length("label"), -F.col("source_ord"), -F.col("row_ord"))).alias("label"),
        F.max(F.struct(F.length("label"), -F.col("source_ord"), -F.col("row_ord"))).alias("size"),
        *[_first(F.struct(c)).alias(c) for c in ("raw_phrase", "confidence_score", "confidence_band")],
    )
    # at most one row per relation type of the vocabulary, so the list below is short
    return per_type.groupBy(*pair).agg(
        F.max_by("label", "size").alias("description"),
        F.transform(F.array_sort(F.collect_list(F.struct("seen", "relation_type"))), lambda s: s["relation_type"]).alias("relation_types"),
        *[F.min_by(F.col(c)[c], "seen").alias(c) for c in ("raw_phrase", "confidence_score", "confidence_band")],
    )
