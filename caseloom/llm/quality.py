"""Quality rules: a table of thresholds compiled into one projection of column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.words import BLANK, bind, word_array

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
# Frequent function words of the four languages of the tables.
STOP_WORDS = (
    "a an and are as at be by for from has in is it of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "als auf das dem den der die ein eine er es für im ist mit nicht sich sie und von wie zu "
    "al como con del el ella en es esta la las lo los no para pero por que se si su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio of measured columns and the closed range a good text lies in; None leaves a side open."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: One added to hits or lines keeps short clean texts from failing on a single miss.
RULES = (
    Rule("words", "n_words", low=20),
    Rule("mean_word", "word_chars / n_words", low=2, high=20),
    Rule("symbols", "n_symbols / n_words", high=0.2),
    Rule("stop_words", "(n_stop_words + 2) / n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines / (n_lines + 1)", high=0.5),
    Rule("line_words", "n_words / greatest(n_lines, 1)", low=1),
)


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of `size` words that occur at least twice in the text.

    Windows are hashed by doubling (pairs, fours, eights), sorted with their positions, and equal neighbours kept;
    covered words are the union of those windows. Texts without a repeated window stop after the distinct count.
    """

    def doubled(hashes: Column, step: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - 1 - step),
            lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + step)),
        )

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bind(ranked, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return bind(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, x: a + x))

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    steps = [1 << n for n in range(size.bit_length() - 1)]
    if 1 << len(steps) != size:
        raise ValueError("the window must be a power of two")

    def count_of(hashes: Column, rest: list[int]) -> Column:
        return bind(doubled(hashes, rest[0]), lambda d: count_of(d, rest[1:])) if rest else count(hashes)

    return F.when(F.size(words) > size, bind(hashed, lambda h: count_of(h, steps))).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """Counts per document of (doc_id, text); a null text counts as empty, a repeated row is measured again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stops = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", text.alias("text"), word_array(text).alias("words"), lines.alias("lines"))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule holds; a ratio that is null (no words) fails."""
    good = F.lit(True)
    for r in rules:
        value = F.expr(r.ratio.replace("/ n_words", "/ nullif(n_words, 0)"))
        if r.low is not None:
            good = good & F.coalesce(value >= F.lit(float(r.low)), F.lit(False))
        if r.high is not None:
            good = good & F.coalesce(value <= F.lit(float(r.high)), F.lit(False))
    return good


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, the base verdict and the verdict of the threshold table, one row per input row.

    Null and empty texts have no words, fail the base rule and are not kept. Other columns of docs are not read.
    """
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return measure(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
