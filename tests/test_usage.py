"""The 95th percentile of a stage's calls is exact, however many latencies there are."""

from pyspark.sql import functions as F

from caseloom.operators.documents import stage_usage

SCHEMA = "stage string, model string, latency_ms double, total_tokens long, error string"


def test_percentile_is_exact(spark):
    calls = spark.range(100_003).select(
        F.lit("s").alias("stage"), F.lit("m").alias("model"), (F.col("id") * 7919 % 100_003).cast("double").alias("latency_ms"), F.lit(1).cast("long").alias("total_tokens"), F.lit(None).cast("string").alias("error"))
    row = stage_usage(calls).first()
    assert (row.calls, row.errors, row.total_tokens, row.mean_latency_ms, row.max_latency_ms) == (100_003, 0, 100_003, 50_001.0, 100_002.0)
    assert row.p95_latency_ms == 95_002.0  # the 95 003rd of 100 003


def test_repeated_and_unknown_latencies(spark):
    rows = [("s", None, 2.0, 1, None)] * 19 + [("s", None, 9.0, None, "x"), ("s", None, None, 1, None), ("t", "m", None, None, None)]
    got = {r.stage: r for r in stage_usage(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["s"].calls, got["s"].errors, got["s"].p95_latency_ms, got["s"].max_latency_ms) == (21, 1, 2.0, 9.0)
    assert (got["t"].calls, got["t"].mean_latency_ms, got["t"].p95_latency_ms) == (1, None, None)
