"""The one hook for external models: a user function over batches of texts, with retries and a trace."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import distinct_ignoring_case, first_json_object, strip

# Waiting times and the order of the evidence sections.
FIRST_WAIT, LONGEST_WAIT = 1.0, 30.0
SECTIONS = ["primary_evidence_text", "entities_and_roles", "events_and_timeline", "movements_and_transfers", "source_and_reporting_context", "supporting_observations"]
REPLY = "key string, reply string, attempts int, error string, latency_ms double"
#: More items than an array can hold, so an item's order never runs into the next row's.
ITEMS = 1 << 31
EXTRACTION = "entities array<struct<name: string, type: string, description: string>>, relations array<struct<src: string, tgt: string, keywords: string, description: string>>"


def model_map(
    rows: DataFrame, fn: Callable[[str], str], *, partitions: int | None = None, window_seconds: float = 60.0,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """(key, text) -> (key, reply, attempts, error, latency_ms), one row per input row.

    fn runs once per text; a failure is tried again after 1, 2, 4 ... at most 30 seconds while the window
    lasts, then its message is kept in the row. partitions bounds how many calls run at once.
    """
    source = rows.select(F.col("key").cast("string").alias("key"), "text")
    if partitions:
        source = source.repartition(partitions)

    def call(text: str) -> tuple:
        started, wait, attempts = time.monotonic(), FIRST_WAIT, 0
        while True:
            attempts += 1
            try:
                reply, error = fn(text), None
            except Exception as exc:  # kept as data
                reply, error = None, f"{type(exc).__name__}: {exc}"
            spent = time.monotonic() - started
            if error is None or spent + wait > window_seconds:
                return reply, attempts, error, spent * 1000
            sleep(wait)
            wait = min(LONGEST_WAIT, wait * 2)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            replies = [call(t) for t in part["text"]]
            out = pd.DataFrame(replies, columns=["reply", "attempts", "error", "latency_ms"])
            out.insert(0, "key", part["key"].to_numpy())
            yield out

    return source.mapInPandas(run, REPLY)


def call_traces(replies: DataFrame, stage: str, model: str) -> DataFrame:
    """Trace rows of the calls, as the usage roll-up reads them."""
    tokens = F.lit(None).cast("long").alias("total_tokens")
    return replies.select(F.col("key").alias("request"), F.lit(stage).alias("stage"), F.lit(model).alias("model"), "latency_ms", tokens, "error")


def extraction_rows(replies: DataFrame, provenance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node records, edge records) of model replies, ready for consolidation.

    provenance(key, case_id, source_id, document_id, row_ord) says where each text came from.
    """
    parsed = replies.select("key", F.from_json(first_json_object(F.col("reply")), EXTRACTION).alias("p")).join(provenance, "key")
    where = ["case_id", "source_id", "document_id"]
    nodes = parsed.select(*where, "row_ord", F.posexplode("p.entities").alias("pos", "e")).select(
        *where, F.lit(0).alias("source_ord"), (F.col("row_ord").cast("long") * ITEMS + F.col("pos")).alias("row_ord"),
        F.col("e.name").alias("entity_name"), F.col("e.type").alias("entity_type"), F.col("e.description").alias("description"))
    edges = parsed.select(*where, "row_ord", F.posexplode("p.relations").alias("pos", "r")).select(
        *where, F.lit(0).alias("source_ord"), (F.col("row_ord").cast("long") * ITEMS + F.col("pos")).alias("row_ord"),
        F.col("r.src").alias("src_id"), F.col("r.tgt").alias("tgt_id"), F.col("r.keywords").alias("keywords"), F.col("r.description").alias("description"))
    return nodes, edges


def evidence_text(reply: Column, original: Column) -> Column:
    """Sections of a structured reply in their order, repeats once; the original text if nothing is usable."""
    body = first_json_object(reply)

    def section(name: str) -> Column:
        value = F.get_json_object(body, f"$.{name}")
        listed = F.from_json(value, "array<string>")
        return F.coalesce(F.when(value.startswith("["), listed), F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>"))

    lines = distinct_ignoring_case(F.filter(F.flatten(F.array(*[section(s) for s in SECTIONS])), lambda v: v.isNotNull()))
    text = F.array_join(lines, "\n\n")
    return F.coalesce(F.nullif(text, F.lit("")), strip(original))


def render_template(template: Column, placeholders: Column, values: Column) -> Column:
    """struct(text, error): {name} replaced by its value; missing or unknown names are errors."""
    missing = F.array_sort(F.array_except(placeholders, F.map_keys(values)))
    unknown = F.array_sort(F.array_except(F.map_keys(values), placeholders))
    error = F.when(F.size(missing) > 0, F.concat(F.lit("missing placeholders: "), F.array_join(missing, ", "))).when(
        F.size(unknown) > 0, F.concat(F.lit("unknown placeholders: "), F.array_join(unknown, ", ")))
    text = F.aggregate(placeholders, template, lambda acc, p: F.replace(acc, F.concat(F.lit("{"), p, F.lit("}")), F.coalesce(F.try_element_at(values, p), F.lit(""))))
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))
