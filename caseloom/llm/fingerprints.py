"""Bottom-k sketches of word-shingle hashes with DataFrame functions only: mergeable, for resemblance, containment and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.llm.words import SHINGLE, bind, word_array

SKETCH = 128
#: Rows of doc_id order meet in this many buckets at most; the borders travel in the plan (8 bytes each).
MOST_BUCKETS = 4096
ROWS_PER_BUCKET = 512


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of `size` words; a shorter text with words is one shingle, one without words has none."""

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    def shingles(h: Column) -> Column:
        return F.when(F.size(h) >= size, runs(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(word_array(text), lambda w: F.xxhash64(w)), shingles)


def sketch(text: Column, k: int = SKETCH, size: int = SHINGLE) -> Column:
    """The k smallest distinct shingle hashes of a text, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, size))), 1, k)


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Share of the merged sketch that both hold: the Jaccard likeness. Two empty sketches are alike, one empty is not."""
    shared = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(bind(merge(a, b, k), shared))


def distinct_count(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / the k-th hash as a share of the hash range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b holds; an empty a is contained in anything."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def merge_sketches(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = SKETCH) -> DataFrame:
    """One sketch per key from any number of parts; each task passes on k hashes per key at most."""
    order = Window.partitionBy(*keys).orderBy("_h")
    hashes = parts.select(*keys, F.explode(column).alias("_h")).groupBy(*keys, "_h").agg(F.lit(1).alias("_one"))
    least = hashes.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def order_borders(docs: DataFrame) -> list[int]:
    """Borders of doc_id ranges of about equal size, from a range partitioning of the ids alone."""
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
    buckets = max(8, min(MOST_BUCKETS, ids.count() // ROWS_PER_BUCKET))
    ranges = ids.repartitionByRange(buckets, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
    return sorted(r.low for r in ranges.collect())


def with_next(docs: DataFrame, borders: list[int]) -> DataFrame:
    """(doc_id, text, sketch) with the text and sketch of the next row in descending doc_id order; the last row's next is the first.

    Rows meet in buckets between borders, so only one text shuffle is needed; the largest row of each bucket is also
    sent to the bucket above, that of the top bucket to the lowest one. Ties of doc_id go by text. A row
    without an id stands outside the order: its next document is itself.
    """
    known = F.array(*[F.lit(b).cast("long") for b in borders]) if borders else F.array().cast("array<bigint>")
    steps = [1 << n for n in reversed(range(max(1, len(borders)).bit_length()))]
    # number of borders at or below the id, by halving steps
    at = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda pos, s: F.when(F.coalesce(F.get(known, pos + s - 1) <= F.col("doc_id"), F.lit(False)), pos + s).otherwise(pos),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", at)
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()
    used = sorted((r.bucket, r.top) for r in tops if r.top is not None)
    above = {top: used[(i + 1) % len(used)][0] for i, (_, top) in enumerate(used)}
    targets = F.create_map(*[x for top, b in above.items() for x in (F.lit(top).cast("long"), F.lit(b))]) if above else None
    places = F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")))
    if targets is not None:
        up = F.try_element_at(targets, F.col("doc_id"))
        places = F.when(up.isNull(), places).otherwise(F.concat(places, F.array(F.struct(up.alias("b"), F.lit(True).alias("guest")))))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.b", "place.guest").repartition("b")
    sketched = dealt.withColumn("sketch", sketch(F.col("text")))
    # a guest comes before all of its bucket; of several rows with the top id, the one last in order is the neighbour
    order = Window.partitionBy("b").orderBy(F.desc("guest"), "doc_id", "text")
    return (
        sketched.withColumn("next_text", F.lag("text").over(order)).withColumn("next_sketch", F.lag("sketch").over(order))
        .filter(~F.col("guest")).drop("b", "guest")
        .withColumn("next_text", F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(F.coalesce("next_text", "text")))
        .withColumn("next_sketch", F.when(F.col("doc_id").isNull(), F.col("sketch")).otherwise(F.coalesce("next_sketch", "sketch")))
    )


def as_string(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited form, and their likeness.

    The edited text ends in the start of the next document's text instead of its own second half. Null texts are
    empty: their fingerprint is the empty string. One row per input row; other columns of docs are not read.
    """
    rows = with_next(docs, order_borders(docs))
    edited = F.concat(
        F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
        F.expr("substring(next_text, 1, cast(floor(char_length(text) / 2) as int))"),
    )
    rows = rows.select("doc_id", "sketch", "next_sketch", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles"),
    )
