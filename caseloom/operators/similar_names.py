"""Names that share most of their words: an exact weighted set-similarity join, and pruning of an entity's weak pairs.

Rare words weigh more. A name's words stand in one order for all names of a group, rare ones first, and two names are only
compared where a word meets that both still have enough weight behind: it stands in the prefix of both, their weights are
close enough, and what is left from that word on can still reach the overlap that the threshold asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.session import cut_lineage

GROUP = ["case_id", "kind"]
THRESHOLD = 60


def word_weights(words: DataFrame, names: DataFrame) -> DataFrame:
    """case_id, kind, word, weight: thousandths of ln(1 + names of the group / names with the word)."""
    sizes = names.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))
    counts = words.groupBy(*GROUP, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(sizes, GROUP).select(*GROUP, "word", F.round(1000 * F.log(1 + F.col("size") / F.col("n"))).cast("long").alias("weight"))


def weighed_names(names: DataFrame) -> DataFrame:
    """names(case_id, kind, name_id, name) with their words as (weight, word), heaviest first, and the sum of weights."""
    words = names.select(*GROUP, "name_id", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    placed = words.join(word_weights(words, names), [*GROUP, "word"])
    listed = placed.groupBy(*GROUP, "name_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("back"), "word"))).alias("words"))
    return names.join(listed, [*GROUP, "name_id"]).withColumn("total", -F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + w["back"]))


def prefix_entries(weighed: DataFrame, percent: int) -> DataFrame:
    """One row per prefix word: with it and the words after it a name can still reach the overlap it needs with any other name."""
    left = F.transform("words", lambda w, i: F.struct(
        w["word"].alias("word"), (-F.aggregate(F.slice("words", i + 1, F.size("words")), F.lit(0).cast("long"), lambda acc, x: acc + x["back"])).alias("rest")))
    kept = F.filter(left, lambda e: e["rest"] * 100 >= F.col("total") * percent)
    numbers = F.xxhash64(F.regexp_extract_all("name", F.lit("[0-9]+"), F.lit(0)))
    return weighed.select(*GROUP, "name_id", "total", numbers.alias("numbers"), F.explode(kept).alias("e")).select(
        *GROUP, "name_id", "total", "numbers", "e.word", "e.rest")


def _enough(shared: Column, one: Column, other: Column, percent: int) -> Column:
    """shared / (one + other - shared) >= percent / 100, in whole numbers."""
    return shared * (100 + percent) >= (one + other) * percent


def similar_names(names: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """case_id, kind, first_id, second_id, shared, joint of all pairs with the same numbers whose shared weight is at least `percent` of the joint one.

    names(case_id, kind, name_id, name) with distinct names, words parted by single blanks. Candidates are pairs of ids; the
    words join later and decide.
    """
    weighed = cut_lineage(weighed_names(names))
    entries = prefix_entries(weighed, percent)
    key = [*GROUP, "numbers", "word"]
    one = entries.select(*key, F.col("name_id").alias("first_id"), F.col("total").alias("a"), F.col("rest").alias("rest_a"))
    two = entries.select(*key, F.col("name_id").alias("second_id"), F.col("total").alias("b"), F.col("rest").alias("rest_b"))
    met = one.join(two, key).filter(
        (F.col("first_id") < F.col("second_id")) & (F.col("a") * 100 >= F.col("b") * percent) & (F.col("b") * 100 >= F.col("a") * percent)
        & _enough(F.least("rest_a", "rest_b"), F.col("a"), F.col("b"), percent))
    pairs = met.select(*GROUP, "first_id", "second_id").distinct()

    def side(of: str) -> DataFrame:
        return weighed.select(*GROUP, F.col("name_id").alias(f"{of}_id"), F.col("words").alias(f"{of}_words"), F.col("total").alias(f"{of}_total"),
                              F.regexp_extract_all("name", F.lit("[0-9]+"), F.lit(0)).alias(f"{of}_numbers"))

    full = pairs.join(side("first"), [*GROUP, "first_id"]).join(side("second"), [*GROUP, "second_id"]).filter("first_numbers = second_numbers")
    shared = -F.aggregate(F.array_intersect("first_words", "second_words"), F.lit(0).cast("long"), lambda acc, w: acc + w["back"])
    rows = full.withColumn("shared", shared).withColumn("joint", F.col("first_total") + F.col("second_total") - F.col("shared"))
    return rows.filter(F.col("shared") * 100 >= F.col("joint") * percent).select(*GROUP, "first_id", "second_id", "shared", "joint")


def strong_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose shared weight is at least the mean of all pairs of one of their two names."""
    ends = pairs.select(*GROUP, "shared", F.explode(F.array("first_id", "second_id")).alias("name_id"))
    means = ends.groupBy(*GROUP, "name_id").agg(F.sum("shared").alias("sum"), F.count(F.lit(1)).alias("n"))

    def of(side: str) -> DataFrame:
        return means.select(*GROUP, F.col("name_id").alias(f"{side}_id"), F.col("sum").alias(f"{side}_sum"), F.col("n").alias(f"{side}_n"))

    judged = pairs.join(of("first"), [*GROUP, "first_id"]).join(of("second"), [*GROUP, "second_id"])
    return judged.filter("shared * first_n >= first_sum or shared * second_n >= second_sum").select(*pairs.columns)
