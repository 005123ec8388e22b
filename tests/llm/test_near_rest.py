"""Pairs hidden in large buckets of texts that are themselves below the bound."""

import random

from pyspark.sql import functions as F

from caseloom.llm import near_dedup
from tests.llm import brute


def hidden_pairs():
    """1200 texts of one template, 0.6 alike, and in their middle twelve pairs about 0.9 alike."""
    rng = random.Random(5)
    word = lambda: f"w{rng.getrandbits(40):x}"
    template = [word() for _ in range(150)]
    own = {d: [word() for _ in range(42)] for d in range(1200)}
    pairs = {500 + 2 * i: 900 + 3 * i for i in range(12)}
    for a, b in pairs.items():
        own[b] = own[a][:-6] + own[b][-6:]
    return [(d, " ".join(template + w)) for d, w in own.items()], pairs


def test_hidden_pairs_of_a_large_bucket(spark, monkeypatch):
    rows, pairs = hidden_pairs()
    of = dict(rows)
    assert brute.likeness(of[0], of[1]) < 0.65 and all(brute.likeness(of[a], of[b]) > 0.85 for a, b in pairs.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # one bucket for all
    monkeypatch.setattr(near_dedup, "banded", lambda d: d.select("doc_id", F.xxhash64("text").alias("digest"), F.array(F.lit(0).cast("long")).alias("bands")))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert got == {d: d for d, _ in rows} | {b: a for a, b in pairs.items()}


def test_rest_pairs_lose_none(spark):
    rng = random.Random(6)
    rows = []
    for d in range(60):
        base = [str(rng.randrange(30)) for _ in range(rng.randrange(5, 60))] if d % 3 == 0 else list(rows[-1][1].split())
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = str(rng.randrange(30))
        rows.append((d, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one_bucket = docs.select("doc_id", F.lit(0).alias("band"), F.lit(0).alias("key"), F.col("doc_id").alias("class"))
    for least in (0.5, 0.8):
        got = {(r.a, r.b) for r in near_dedup.rest_pairs(one_bucket, docs, least).collect()}
        true = {(a, b) for a, x in rows for b, y in rows if a > b and brute.likeness(x, y) >= least}
        assert true and true <= got
