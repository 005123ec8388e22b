"""Importance resampling towards a target: hashed n-grams of words, their CRCs taken from running CRCs of the text.

A text is normalised to its words with one blank between them and scanned once; the running CRC-32 is kept at both ends of
every word. The CRC of any run of words is that of the text up to its end, less that of the text up to its start moved on by
the run's bytes: moving by zero bytes is linear over GF(2), so it is done for whole arrays with tables for powers of two.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.session import cut_lineage, number_rows

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Bytes of text handled at a time; a single longer text is handled on its own.
CHUNK_BYTES = 1 << 22
#: The reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

# what a byte becomes: digits, small letters and all of non-ASCII stay, capital letters are lowered, the rest parts words
NORMAL = bytes(b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


@lru_cache(1)
def _one_byte() -> np.ndarray:
    """The CRC register after each byte, from zero."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


@lru_cache(40)
def _shift_table(k: int) -> np.ndarray:
    """Four tables, one for each byte of a register, that move it on by 2^k zero bytes."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k:
        images = _moved(_moved(images, k - 1), k - 1)
    else:
        images = _one_byte()[images & np.uint32(255)] ^ (images >> np.uint32(8))
    tables = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        tables[bit // 8][(np.arange(256) >> (bit % 8)) & 1 == 1] ^= images[bit]
    return tables


def _moved(crcs: np.ndarray, k: int) -> np.ndarray:
    a, b, c, d = _shift_table(k)
    return a[crcs & np.uint32(255)] ^ b[(crcs >> np.uint32(8)) & np.uint32(255)] ^ c[(crcs >> np.uint32(16)) & np.uint32(255)] ^ d[crcs >> np.uint32(24)]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many zero bytes each."""
    crcs = crcs.astype(np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero((lengths >> k) & 1)
        crcs[some] = _moved(crcs[some], k)
    return crcs


def _next_word(crc: int, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(b" ", crc))


def run_crcs(texts: list[str | None], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to `most` words of every text, text by text; the runs and the words of each text."""
    split = [t.encode("utf-8").translate(NORMAL).split() if t else [] for t in texts]
    words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    total = int(words.sum())
    # the blank that leads every text is one more prefix, so that each word starts after one
    ends = np.fromiter(chain.from_iterable(accumulate(ws, _next_word, initial=0) for ws in split), dtype=np.uint32, count=total + len(split))
    sizes = np.fromiter(map(len, chain.from_iterable(split)), dtype=np.int64, count=total)
    owner = np.repeat(np.arange(len(split)), words)
    upto = np.delete(ends, np.cumsum(words + 1) - words - 1)
    before = np.delete(ends, np.cumsum(words + 1) - 1)
    # the register after the blank before each word
    flipped = ~before
    before = ~(_one_byte()[(flipped ^ np.uint32(0x20)) & np.uint32(255)] ^ (flipped >> np.uint32(8)))
    reach = np.cumsum(sizes + 1)
    crcs, owners = [], []
    for n in range(1, most + 1):
        last = np.arange(n - 1, total)
        start = last - (n - 1)
        same = owner[last] == owner[start]
        last, start = last[same], start[same]
        lengths = reach[last] - reach[start] + sizes[start]
        crcs.append(upto[last] ^ shifted(before[start], lengths))
        owners.append(owner[last])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable") if most > 1 else np.arange(len(owners))
    return np.concatenate(crcs)[order], np.bincount(owners, minlength=len(split)), words


def _slices(texts: pa.Array):
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
        yield at, to
        at = to


def features(docs: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the bucket of every feature of docs(doc_id, text); null and empty texts have none."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in _slices(texts):
                crcs, runs, words = run_crcs(texts.slice(a, b - a).to_pylist(), most)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs)]), pa.int32()), pa.array((crcs % np.uint32(buckets)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(words), pa.array(runs.astype(np.int64)), lists],
                    ["doc_id", "n_words", "n_features", "buckets"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, buckets array<int>")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """How many features of all rows lie in each bucket that has any."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket: the log of its smoothed share of the target over that of the source, in thousandths."""
    spark = source.sparkSession
    sides = source.withColumn("_of", F.lit("s")).unionByName(target.withColumn("_of", F.lit("t")))
    per = sides.unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit("").alias("_of")))
    counted = cut_lineage(per.groupBy("bucket").agg(*[F.sum(F.when(F.col("_of") == side, F.col("n")).otherwise(0)).alias(side) for side in ("s", "t")]))
    totals = counted.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(totals.all_s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(totals.all_t + buckets))
    return counted.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain"))


def weigh(rows: DataFrame, gains: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """rows without their buckets, with the sum of their gains as weight. The gains, one number a bucket, go to every task."""
    of = np.zeros(buckets, dtype=np.int64)
    for r in gains.collect():
        of[r.bucket] = r.gain

    def run(batches):
        for batch in batches:
            lists = batch.column("buckets")
            sums = np.concatenate([[0], np.cumsum(of[lists.flatten().to_numpy(zero_copy_only=False)])])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            kept = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int = SEED) -> Column:
    """A document's own noise in thousandths, from its id; rows without an id have that of an empty one."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def resample(
    docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Every document with its weight towards the target and, if drawn, its rank: doc_id, n_words, n_features, weight, score, rank.

    target has a column text. Drawn are the best `percent` of the documents with enough words, by weight and noise, the
    smaller id before on ties. Null and empty texts have no features and weight 0, and are never drawn; repeated rows count
    and are drawn each on its own; an empty target makes all buckets of one size alike; an empty table gives no rows.
    Other columns of docs are left out.
    """
    own = cut_lineage(features(docs, most, buckets))
    aim = features(target.select(F.lit(0).alias("doc_id"), "text"), most, buckets)
    scored = weigh(own, bucket_gains(bucket_counts(own), bucket_counts(aim), buckets), buckets).withColumn("score", F.col("weight") + gumbel(seed))
    scored = cut_lineage(scored)
    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * percent // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = number_rows(scored.filter(enough).withColumn("_down", -F.col("score")), [], ["_down", "doc_id"], "rank").drop("_down")
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return ranked.select(*names, "rank").unionByName(rest.select(*names, "rank")).select(*names, rank)
