"""Which short texts are part of others: sorted suffixes, each text looked up beside its neighbour in the order.

A text is part of another if it begins one of its suffixes. In sorted order the suffixes that a text begins follow it at once,
so the next suffix alone decides. The other way round, of texts none of which begins another one, only the last one before a
suffix can begin it. Both need one row per character of a text, and no list of all its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.session import nearest_value

SPAN, SUFFIX = 0, 1


def _suffixes(texts: DataFrame, keys: list[str]) -> DataFrame:
    starts = F.sequence(F.lit(1), F.length("text"))
    return texts.filter("text <> ''").select(*keys, "text", F.explode(F.transform(starts, lambda i: F.substr("text", i))).alias("at"))


def spans_within(texts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, span of the spans(keys, span) that are part of some text of texts(keys, text) with the same keys; empty spans never are."""
    asked = spans.filter("span <> ''").select(*keys, F.col("span").alias("at"), F.lit(SPAN).alias("kind"), F.lit(None).cast("string").alias("suffix")).distinct()
    listed = _suffixes(texts, keys).select(*keys, "at", F.lit(SUFFIX).alias("kind"), F.col("at").alias("suffix")).distinct()
    placed = nearest_value(asked.unionByName(listed), keys, ["at", "kind"], "suffix", "next")
    return placed.filter((F.col("kind") == SPAN) & F.startswith("next", "at")).select(*keys, F.col("at").alias("span"))


def shortest_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The spans that no other span of the same keys begins."""
    own = spans.filter("span <> ''").select(*keys, "span").distinct()
    lengths = F.sequence(F.lit(1), F.length("span") - 1)
    heads = own.filter(F.length("span") > 1).select(*keys, "span", F.explode(F.transform(lengths, lambda n: F.substr("span", F.lit(1), n))).alias("head"))
    longer = heads.join(own.withColumnRenamed("span", "head"), [*keys, "head"], "left_semi").select(*keys, "span")
    return own.join(longer, [*keys, "span"], "left_anti")


def texts_around(texts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text of the texts(keys, text) that hold some span of spans(keys, span) with the same keys."""
    asked = shortest_spans(spans, keys).select(*keys, F.col("span").alias("at"), F.lit(SPAN).alias("kind"), F.lit("").alias("text"), F.col("span"))
    listed = _suffixes(texts.select(*keys, "text").distinct(), keys).select(*keys, "at", F.lit(SUFFIX).alias("kind"), "text", F.lit(None).cast("string").alias("span"))
    placed = nearest_value(asked.unionByName(listed), keys, ["at", "kind", "text"], "span", "before", ahead=False)
    return placed.filter((F.col("kind") == SUFFIX) & F.startswith("at", "before")).select(*keys, "text").distinct()
