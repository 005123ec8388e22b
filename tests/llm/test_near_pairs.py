"""How many pairs of texts are fetched and compared."""

from pyspark.sql import functions as F

from caseloom.llm import near_dedup
from tests.llm.test_near_rest import hidden_pairs


def test_few_pairs_are_fetched_in_a_large_bucket(spark, monkeypatch):
    rows, pairs = hidden_pairs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fetched, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda p, *rest: fetched.append(p.count()) or verified(p, *rest))
    monkeypatch.setattr(near_dedup, "banded", lambda d: d.select("doc_id", F.xxhash64("text").alias("digest"), F.array(F.lit(0).cast("long")).alias("bands")))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert {b: got[b] for b in pairs.values()} == {b: a for a, b in pairs.items()}
    assert sum(fetched) <= 2.1 * len(rows)  # each with the ends of its bucket, then hardly more than the hidden ones
