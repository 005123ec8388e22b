"""Retrieval-quality metrics per question and their summary.

The retrieved side of a question is its top k (at most 100 rows), so the per-question joins grow with the
expected side only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import bind, file_key, pick_text, strip
from caseloom.operators.suffixes import spans_within, texts_around

QUERY = "query_id"

# Fixed values of the metrics.
ENTITY_THRESHOLD = RELATION_THRESHOLD = 0.80
CONTEXT_CHARS = 8000
CITATION = r"\[(\d+)\]"


def _keys(rows: DataFrame, path: str) -> DataFrame:
    return rows.select(QUERY, file_key(F.col(path)).alias("key")).filter("key <> ''").distinct()


def matched_keys(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Expected keys (query_id, key) that equal a returned key, contain one, or are part of one."""
    inside = spans_within(returned.select(QUERY, F.col("key").alias("text")), expected.select(QUERY, F.col("key").alias("span")), [QUERY])
    around = texts_around(expected.select(QUERY, F.col("key").alias("text")), returned.select(QUERY, F.col("key").alias("span")), [QUERY])
    return inside.withColumnRenamed("span", "key").unionByName(around.withColumnRenamed("text", "key")).distinct()


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(QUERY).agg(F.count(F.lit(1)).alias(name))


def _with_counts(questions: DataFrame, *counted: tuple[DataFrame, str]) -> DataFrame:
    out = questions.select(QUERY)
    for rows, name in counted:
        out = out.join(_count(rows, name), QUERY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def _rate(part: str | Column, whole: str) -> Column:
    hits = F.col(part) if isinstance(part, str) else part
    return F.when(F.col(whole) > 0, F.round(hits / F.col(whole), 4))


def source_metrics(questions: DataFrame, expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Counts, recall, precision and hit of source files; expected and returned are (query_id, path)."""
    want, have = _keys(expected, "path"), _keys(returned, "path")
    rows = _with_counts(questions, (want, "expected_count"), (have, "returned_count"), (matched_keys(want, have), "matched_count"))
    return rows.select(
        "*", _rate("matched_count", "expected_count").alias("source_recall"), _rate("matched_count", "returned_count").alias("source_precision"),
        F.when(F.col("matched_count") > 0, 1.0).otherwise(0.0).alias("source_hit"))


def unit(vector: Column) -> Column:
    """The vector scaled to length one, zeros if it has no length."""
    wide = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return bind(length, lambda norm: F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


#: A question's expected rows are spread over so many parts; its few retrieved rows go to each.
PARTS = 32


def met(expected: DataFrame, retrieved: DataFrame, *keys: str) -> DataFrame:
    """Every expected row of a question with every retrieved one, without putting a question into one task."""
    left = expected.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    right = retrieved.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return left.join(right, [QUERY, "_part"]).drop("_part")


def entity_matches(questions: DataFrame, expected: DataFrame, retrieved: DataFrame, threshold: float = ENTITY_THRESHOLD) -> DataFrame:
    """Semantic and exact hits of entities; both sides are (query_id, key, vector)."""
    want = expected.select(QUERY, "key", unit(F.col("vector")).alias("v"))
    have = retrieved.select(QUERY, F.col("key").alias("found"), unit(F.col("vector")).alias("w"))
    near = met(want, have, "key").select(QUERY, "key", "found", dot(F.col("v"), F.col("w")).alias("s")).filter(F.col("s") >= threshold)
    recall, precision = near.select(QUERY, "key").distinct(), near.select(QUERY, "found").distinct()
    exact = expected.select(QUERY, "key").distinct().join(retrieved.select(QUERY, "key"), [QUERY, "key"], "left_semi")
    rows = _with_counts(questions, (expected, "expected_entity_count"), (retrieved, "retrieved_entity_count"), (recall, "matched_entity_count"),
                        (precision, "_precise"), (exact, "_exact"))
    return rows.select(
        QUERY, "expected_entity_count", "retrieved_entity_count", "matched_entity_count",
        _rate("matched_entity_count", "expected_entity_count").alias("entity_recall"), _rate("_precise", "retrieved_entity_count").alias("entity_precision"),
        _rate("_exact", "expected_entity_count").alias("entity_recall_exact"), _rate("_exact", "retrieved_entity_count").alias("entity_precision_exact"))


def relation_matches(questions: DataFrame, expected: DataFrame, retrieved: DataFrame, threshold: float = RELATION_THRESHOLD, undirected: bool = True) -> DataFrame:
    """Hits of relations by both ends; both sides are (query_id, src, tgt, src_vector, tgt_vector)."""
    want = expected.select(QUERY, "src", "tgt", unit(F.col("src_vector")).alias("vs"), unit(F.col("tgt_vector")).alias("vt"))
    have = retrieved.select(QUERY, F.col("src").alias("s2"), F.col("tgt").alias("t2"), unit(F.col("src_vector")).alias("ws"), unit(F.col("tgt_vector")).alias("wt"))
    score = F.least(dot(F.col("vs"), F.col("ws")), dot(F.col("vt"), F.col("wt")))
    if undirected:
        score = F.greatest(score, F.least(dot(F.col("vs"), F.col("wt")), dot(F.col("vt"), F.col("ws"))))
    near = met(want, have, "src", "tgt").withColumn("score", score).filter(F.col("score") >= threshold)
    recall, precision = near.select(QUERY, "src", "tgt").distinct(), near.select(QUERY, "s2", "t2").distinct()
    pairs = retrieved.select(QUERY, "src", "tgt")
    if undirected:
        pairs = pairs.unionByName(retrieved.select(QUERY, F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    exact = expected.select(QUERY, "src", "tgt").join(pairs.distinct(), [QUERY, "src", "tgt"], "left_semi")
    rows = _with_counts(questions, (expected, "expected_relation_count"), (retrieved, "retrieved_relation_count"), (recall, "matched_relation_count"),
                        (precision, "_precise"), (exact, "_exact"))
    return rows.select(
        QUERY, "expected_relation_count", "retrieved_relation_count", "matched_relation_count",
        _rate("matched_relation_count", "expected_relation_count").alias("relation_recall"), _rate("_precise", "retrieved_relation_count").alias("relation_precision"),
        _rate("_exact", "expected_relation_count").alias("relation_recall_exact"), _rate("_exact", "retrieved_relation_count").alias("relation_precision_exact"))


def connectivity_recall(questions: DataFrame, expected: DataFrame, retrieved_nodes: DataFrame, threshold: float = RELATION_THRESHOLD) -> DataFrame:
    """Share of expected relations whose two ends both resemble any retrieved node; null without expectation.

    expected(query_id, src, tgt, src_vector, tgt_vector); retrieved_nodes(query_id, key, vector).
    """
    ends = expected.select(QUERY, F.explode(F.array(
        F.struct(F.col("src").alias("key"), F.col("src_vector").alias("vector")), F.struct(F.col("tgt").alias("key"), F.col("tgt_vector").alias("vector")))).alias("e")).select(QUERY, "e.*").dropDuplicates([QUERY, "key"])
    near = met(ends.select(QUERY, "key", unit(F.col("vector")).alias("v")), retrieved_nodes.select(QUERY, unit(F.col("vector")).alias("w")), "key")
    present = near.filter(dot(F.col("v"), F.col("w")) >= threshold).select(QUERY, "key").distinct()
    covered = expected.select(QUERY, "src", "tgt").join(present.withColumnRenamed("key", "src"), [QUERY, "src"], "left_semi").join(
        present.withColumnRenamed("key", "tgt"), [QUERY, "tgt"], "left_semi")
    rows = _with_counts(questions, (expected, "_n"), (covered, "_covered"))
    return rows.select(QUERY, _rate("_covered", "_n").alias("relation_connectivity_recall"))


def graph_metric_rows(questions: DataFrame, *metrics: DataFrame) -> DataFrame:
    """questions(query_id, mode, out_of_scope) with all graph metrics; null in naive mode and out of scope."""
    out = questions
    for m in metrics:
        out = out.join(m, QUERY, "left")
    silent = (F.col("mode") == "naive") | F.col("out_of_scope")
    kept = {c: F.when(~silent, F.col(c)) for c in out.columns if c not in questions.columns and not c.startswith("expected_")}
    return out.withColumns(kept)


def citation_metrics(questions: DataFrame, expected: DataFrame, references: DataFrame) -> DataFrame:
    """Cited and surfaced source files of answers.

    questions(query_id, answer); expected(query_id, path); references(query_id, pos, reference_id, path).
    """
    by_id = references.filter((strip(F.col("reference_id")) != "") & (F.col("path") != "")).groupBy(QUERY, strip(F.col("reference_id")).alias("reference_id")).agg(
        file_key(F.max_by("path", "pos")).alias("key"))
    marks = questions.select(QUERY, F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(1)))).alias("reference_id"))
    cited = marks.join(by_id, [QUERY, "reference_id"]).select(QUERY, "key").distinct()
    want, have = _keys(expected, "path"), _keys(references, "path")
    named = cited.filter("key <> ''")
    rows = _with_counts(questions, (want, "_want"), (have, "returned_count"), (cited, "cited_count"),
                        (matched_keys(want, have), "matched_count"), (matched_keys(want, named), "_cited_match"))
    none = F.col("_want") == 0

    def strict(hits: str, total: str) -> Column:
        return F.when(none, F.when(F.col(total) == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(_rate(hits, total), F.lit(0.0)))

    def hit(c: str) -> Column:
        return F.when(~none, F.when(F.col(c) > 0, 1.0).otherwise(0.0))

    return rows.select(
        QUERY, "cited_count", F.col("_cited_match").alias("matched_citation_count"),
        _rate("_cited_match", "_want").alias("citation_recall"), strict("_cited_match", "cited_count").alias("citation_precision"), hit("_cited_match").alias("citation_hit"),
        F.col("_want").alias("expected_count"), "returned_count", "matched_count",
        _rate("matched_count", "_want").alias("provenance_recall"), strict("matched_count", "returned_count").alias("provenance_precision"), hit("matched_count").alias("provenance_hit"))


def assemble_contexts(texts: Column, entities: Column, relations: Column, with_graph: bool = True, max_chars: int = CONTEXT_CHARS) -> Column:
    """Context list of a result: its texts, then one block of entities and one of relations.

    entities array<struct<name,description>>, relations array<struct<src_id,relation_type,tgt_id,description>>.
    """
    def extra(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" ("), c, F.lit(")"))).otherwise("")

    cleaned = F.transform(F.filter(F.transform(texts, strip), lambda t: t.isNotNull() & (t != "")), lambda t: F.substring(t, 1, max_chars))
    if not with_graph:
        return cleaned
    names = F.array_join(F.transform(entities, lambda e: F.concat(e["name"], extra(e["description"]))), "; ")
    links = F.array_join(F.transform(relations, lambda r: F.concat(
        F.coalesce(r["src_id"], F.lit("?")), F.lit(" → "), F.coalesce(r["relation_type"], F.lit("?")), F.lit(" → "), F.coalesce(r["tgt_id"], F.lit("?")), extra(r["description"]))), "; ")
    blocks = F.array(
        F.when(F.size(entities) > 0, F.substring(F.concat(F.lit("Graph entities: "), names), 1, max_chars)),
        F.when(F.size(relations) > 0, F.substring(F.concat(F.lit("Graph relationships: "), links), 1, max_chars)))
    return F.concat(cleaned, F.array_compact(blocks))


def evidence_reference(chunks: Column, *answers: Column) -> Column:
    """Gold evidence chunks line by line, else the reference answer."""
    kept = F.filter(F.transform(chunks, strip), lambda c: c.isNotNull() & (c != ""))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.array_join(kept, "\n")).otherwise(F.coalesce(pick_text(*answers), F.lit("")))


def summary_by_mode(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """n and the mean of every metric per mode and scope; values that are no finite number do not count."""
    def mean(c: str) -> Column:
        x = F.col(c).cast("string").try_cast("double")
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
        return F.round(F.avg(F.when(finite, x)), 4).alias(c)

    return rows.groupBy(F.coalesce("mode", F.lit("unknown")).alias("mode"), F.coalesce("out_of_scope", F.lit(False)).alias("out_of_scope")).agg(
        F.count(F.lit(1)).alias("n"), *[mean(m) for m in metrics])
