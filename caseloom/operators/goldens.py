"""Golden question sets: schedule, validation, verbatim evidence, sampling, corpus manifest."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import squeeze
from caseloom.functions.vocabulary import ENTITY_TYPES
from caseloom.operators.containment import containing_pairs
from caseloom.session import cut_lineage, number_rows

# Fixed values of the golden sets.
ANALYSIS_TYPES = ["link", "temporal", "flow", "factual_verification", "retrieval_honesty"]
PHASES = ["retrieval", "generation"]
RELATION_LABEL = "^[A-Z][A-Z0-9_]*$"
PUNCTUATION = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-"}
ELLIPSIS = "..."


def schedule(spec: DataFrame) -> DataFrame:
    """spec(dataset_id, type_ord, analysis_type, source_span, count) -> one row per question with ids Q01, Q02, ..."""
    rows = spec.filter("count > 0").select(
        "dataset_id", "type_ord", "analysis_type", "source_span", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    numbered = number_rows(rows, ["dataset_id"], ["type_ord", "source_span", "copy"], "n")
    return numbered.select("dataset_id", question_id(F.col("n")).alias("id"), "analysis_type", "source_span")


def question_id(n: Column) -> Column:
    text = n.cast("string")
    return F.concat(F.lit("Q"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))


def row_errors(golden: DataFrame) -> DataFrame:
    """(dataset_id, id, error) of rows that break a rule.

    golden(dataset_id, id, analysis_type, phases, question, reference_answer, entities array<struct<name,type>>,
    relations array<struct<src,relation,tgt>>, chunks array<string>, citation_targets array<string>, out_of_scope).
    """
    def empty(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    def blank(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    names = F.transform("entities", lambda e: e["name"])
    bad_entity = F.exists("entities", lambda e: ~F.coalesce(e["type"].isin(ENTITY_TYPES), F.lit(False)) | (F.coalesce(e["name"], F.lit("")) == ""))
    loose_end = F.exists("relations", lambda r: ~F.array_contains(names, r["src"]) | ~F.array_contains(names, r["tgt"]))
    bad_label = F.exists("relations", lambda r: ~F.coalesce(r["relation"], F.lit("")).rlike(RELATION_LABEL))
    filled = ~empty("entities") | ~empty("relations") | ~empty("chunks") | ~empty("citation_targets")
    lacking = empty("entities") | empty("relations") | empty("chunks")
    rules = [
        (~F.coalesce(F.col("analysis_type").isin(ANALYSIS_TYPES), F.lit(False)), "invalid analysis_type"),
        (~F.coalesce(F.array_join("phases", ",") == ",".join(PHASES), F.lit(False)), "phases must be retrieval, generation"),
        (blank("question") | blank("reference_answer"), "question and reference_answer are required"),
        (F.col("out_of_scope") & filled, "out-of-scope rows must be empty"),
        (~F.col("out_of_scope") & lacking, "entities, relationships and chunks are required"),
        (bad_entity, "invalid entity"),
        (loose_end, "relationship endpoint missing from entities"),
        (bad_label, "invalid relationship label"),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), text) for test, text in rules]))
    return golden.select("dataset_id", "id", F.explode(errors).alias("error"))


def dataset_errors(golden: DataFrame, expected: DataFrame) -> DataFrame:
    """(dataset_id, error, detail): repeated questions, ids out of order, and distributions that differ.

    golden(dataset_id, ord, id, question, analysis_type, source_span); expected(dataset_id, analysis_type, source_span).
    """
    key = F.lower(F.trim("question"))
    repeated = golden.filter(key != "").groupBy("dataset_id", key.alias("detail")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "dataset_id", F.lit("duplicate question").alias("error"), "detail")
    numbered = number_rows(golden.select("dataset_id", "ord", "id"), ["dataset_id"], ["ord"], "n")
    misnamed = numbered.filter(~F.col("id").eqNullSafe(question_id(F.col("n")))).select("dataset_id", F.lit("non-sequential id").alias("error"), F.col("id").alias("detail"))
    out = repeated.unionByName(misnamed)
    for column in ("analysis_type", "source_span"):
        def counts(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("dataset_id", F.col(column).cast("string").alias("detail")).agg(F.count(F.lit(1)).alias(name))

        both = counts(golden, "have").join(counts(expected, "want"), ["dataset_id", "detail"], "full")
        differs = both.filter(~F.col("have").eqNullSafe(F.col("want")))
        out = out.unionByName(differs.select("dataset_id", F.lit(f"{column} distribution").alias("error"), "detail"))
    return out


def canonical_text(c: Column) -> Column:
    """Compatibility-normalised text with plain quotes and dashes and single blanks.

    Only texts with characters beyond ASCII pass through Python.
    """

    @F.pandas_udf("string")
    def compatible(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    foreign = c.rlike(r"[^\x00-\x7F]")
    folded = F.coalesce(compatible(F.when(foreign, c)), c)
    return squeeze(F.translate(folded, "".join(PUNCTUATION), "".join(PUNCTUATION.values())))


def spans_in_sources(sources: DataFrame, spans: DataFrame, keys: list[str], allow_ellipses: bool = False) -> DataFrame:
    """(keys, text_id, span_id) of spans that occur word for word in a source.

    With allow_ellipses a span may leave out passages marked by "...": its parts must follow each other.
    """
    # read twice below, once for its words and once to decide, so the texts are folded only once
    texts = cut_lineage(sources.select(*keys, "text_id", canonical_text(F.col("text")).alias("text")))
    plain = spans.select(*keys, "span_id", canonical_text(F.col("span")).alias("span"))
    whole = containing_pairs(texts, plain, keys)
    if not allow_ellipses:
        return whole
    parts = F.filter(F.transform(F.split("span", r"\.\.\."), lambda p: F.trim(p)), lambda p: p != "")
    broken = plain.filter(F.col("span").contains(ELLIPSIS)).withColumn("parts", parts).filter(F.size("parts") > 0)
    longest = F.array_max(F.transform("parts", lambda p: F.struct(F.length(p), p.alias("p"))))["p"]
    near = containing_pairs(texts, broken.select(*keys, "span_id", longest.alias("span")), keys)
    rows = near.join(broken.select(*keys, "span_id", "parts"), [*keys, "span_id"]).join(texts, [*keys, "text_id"])

    def follow(position: Column, part: Column) -> Column:
        found = F.call_function("locate", part, F.col("text"), position)
        return F.when(position == 0, 0).when(found > 0, found + F.length(part)).otherwise(0)

    in_order = rows.filter(F.aggregate("parts", F.lit(1), follow) > 0).select(*keys, "text_id", "span_id")
    return whole.unionByName(in_order).distinct()


def seeded(seed: int) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the seed and the document id only."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "document_id").cast("binary")), 1, 8), 16, 10).cast("long")


def sample_sources(documents: DataFrame, n: int, seed: int) -> DataFrame:
    """n documents in the order of a seeded hash of their id: the same seed gives the same sample."""
    return documents.orderBy(seeded(seed), "document_id").limit(n)


def sample_context(chunks: DataFrame, per_source: int, seed: int) -> DataFrame:
    """A run of consecutive chunks of every document, starting at a seeded place.

    chunks(case_id, document_id, chunk_order, ...) with chunk_order from 0 without gaps.
    """
    counts = chunks.groupBy("case_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    take = F.least(F.col("n"), F.lit(per_source))
    started = counts.select("case_id", "document_id", take.alias("take"), F.pmod(seeded(seed), F.col("n") - take + 1).alias("start"))
    return chunks.join(started, ["case_id", "document_id"]).filter(
        (F.col("chunk_order") >= F.col("start")) & (F.col("chunk_order") < F.col("start") + F.col("take"))).drop("take", "start")


def corpus_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files added, removed or changed between two manifests (file_name, sha256)."""
    both = current.select("file_name", F.col("sha256").alias("now")).join(previous.select("file_name", F.col("sha256").alias("before")), "file_name", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    return both.select("file_name", change.alias("change")).filter(F.col("change").isNotNull())
