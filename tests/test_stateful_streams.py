"""Streams with kept checkpoints: late and repeated rows, restarts, timers, state that does not grow."""

import pytest

from caseloom.streaming import stateful


@pytest.fixture()
def feed(spark, tmp_path):
    """Puts rows into a folder and runs the stream over what is new; every call is a restart from the kept checkpoint."""
    def put(start, rows, schema, casts, **options):
        folder = tmp_path / "in"
        frame = spark.createDataFrame(rows, schema)
        frame.selectExpr(*[f"timestamp_seconds({c}) as {c}" if c in casts else c for c in frame.columns]).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))
        running = start(stream, str(tmp_path / "out"), str(tmp_path / "check"), **options)
        running.awaitTermination()
        written = list((tmp_path / "out").rglob("*.parquet"))
        return running, spark.read.parquet(str(tmp_path / "out")) if written else None
    return put


def test_intake_within_the_look_back(feed):
    put = lambda rows: feed(stateful.intake_within, rows, "case_id string, document_id string, content string, arrived_at long", ["arrived_at"], look_back="100 seconds")
    ids = lambda out: sorted(r.document_id for r in out.collect())
    _, out = put([("c", "1", "same", 1000), ("c", "1b", "same", 1000), ("d", "2", "same", 1000)])
    assert len(ids(out)) == 2 and "2" in ids(out)
    _, out = put([("c", "3", "same", 1050), ("c", "4", "other", 1190)])  # known within the look-back, over a restart
    assert len(ids(out)) == 3 and "4" in ids(out)
    _, out = put([("c", "5", "new", 1020), ("c", "6", "other", 1200)])  # 5 is late: the stream has seen 1190
    assert len(ids(out)) == 3
    _, out = put([("c", "7", "same", 1300)])  # the first one is out of the look-back
    running, out = put([("c", "8", "last", 1500)])
    assert len(ids(out)) == 5 and {"7", "8"} <= set(ids(out))
    assert running.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_usage_windows_close_once(feed):
    schema = "called_at long, stage string, model string, latency_ms double, total_tokens long, error string"
    put = lambda rows: feed(stateful.usage_windows, rows, schema, ["called_at"], window="10 seconds", late="5 seconds")
    calls = lambda out: sorted((r.from_time.timestamp() % 86400, r.calls, r.errors, r.total_tokens) for r in out.collect())
    _, out = put([(100, "s", "m", 1.0, 5, None), (101, "s", "m", 9.0, 5, "x"), (112, "s", "m", 2.0, 1, None)])
    assert out is None
    _, out = put([(108, "s", "m", 3.0, 1, None), (118, "s", "m", 4.0, 1, None)])  # the first window is still open for 108
    first = calls(out)
    assert [c[1:] for c in first] == [(3, 1, 11)]
    running, out = put([(109, "s", "m", 7.0, 9, None), (160, "s", "m", 5.0, 1, None)])  # 109 is too late for its window
    assert [c[1:] for c in calls(out)] == [(3, 1, 11), (2, 0, 2)]
    assert running.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the open window only
    whole = stateful.usage_over(out, "stage").first()
    assert (whole.calls, whole.errors, whole.max_latency_ms, whole.p50_latency_ms) == (5, 1, 9.0, 3.0)


def test_jobs_stall_and_are_forgotten(feed):
    put = lambda rows: feed(stateful.track_jobs_with_timers, rows, "job_id long, status string, seq long, reported_at long", ["reported_at"], stall="100 seconds", keep="300 seconds", late="10 seconds")
    states = lambda out: {r.job_id: (r.status, r.seq, r.terminal) for r in stateful.tracked_jobs(out).collect()}
    _, out = put([(1, "queued", 1, 1000), (1, "parsing", 2, 1001), (2, "parsing", 1, 1000), (3, "indexing", 1, 1000)])
    assert states(out) == {1: ("parsing", 2, False), 2: ("parsing", 1, False), 3: ("indexing", 1, False)}
    _, out = put([(2, "complete", 3, 1050), (3, "parsing", 2, 1090), (1, "queued", 1, 1060)])  # an old report changes nothing
    assert states(out) == {1: ("parsing", 2, False), 2: ("complete", 3, True), 3: ("parsing", 2, False)}
    _, out = put([(4, "queued", 1, 1150)])  # 1 was last heard of at 1001
    assert states(out)[1] == ("failed", 2, True) and states(out)[3] == ("parsing", 2, False)
    _, out = put([(3, "completed_with_warnings", 5, 1160), (1, "indexing", 7, 1170)])  # a failed job may go on
    assert states(out)[1] == ("indexing", 7, False) and states(out)[3] == ("completed_with_warnings", 5, True)
    put([(4, "complete", 2, 1180), (1, "complete", 9, 1181)])
    running, out = put([(5, "queued", 1, 5000)])
    assert states(out)[4] == ("complete", 2, True) and states(out)[1] == ("complete", 9, True)
    running, out = put([(5, "queued", 2, 5001)])
    assert running.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # only job 5 and what it needs
