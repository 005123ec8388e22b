"""Results that must not depend on partitions, batch sizes or skew."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import consolidate, integrity, model_map as mm, retrieve as rt, traverse
from caseloom.session import number_rows


def test_row_numbers_of_a_hot_key(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (-F.col("id")).alias("o"))
    got = number_rows(rows, ["k"], ["o"], "n").filter("k = 'hot'").orderBy("o").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))


def test_search_does_not_depend_on_blocks(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("'c' as case_id", "'v' || vec_id as item_id", "embedding as vector")
    q = v.select(F.col("item_id").alias("query_id"), "case_id", "vector")
    small = rt.vector_topk(q, v, 3, 0.1).collect()
    monkeypatch.setattr(rt, "BLOCK_QUERIES", 64)
    monkeypatch.setattr(rt, "SHARD_VECTORS", 50)
    large = rt.vector_topk(q, v, 3, 0.1).collect()
    assert sorted((r.query_id, r.rank, r.item_id, r.score) for r in small) == sorted((r.query_id, r.rank, r.item_id, r.score) for r in large)


def _edges(spark):
    rows = [("c", f"e{i}", f"n{i % 7}", f"n{(i * 3) % 11}", "T", "t") for i in range(40)]
    return spark.createDataFrame(rows, "case_id string, edge_id string, src_id string, tgt_id string, relation_type string, label string")


def test_neighbourhood_grows_with_hops_and_degrees_add_up(spark):
    edges = _edges(spark)
    seeds = spark.createDataFrame([("c", "n0")], "case_id string, node_id string")
    sizes = [traverse.khop_nodes(edges, seeds, k).count() for k in range(4)]
    assert sizes[0] == 1 and sizes == sorted(sizes)
    none = spark.createDataFrame([], "case_id string, node_id string, label string, entity_type string, summary string")
    nodes = consolidate.with_degree(consolidate.implicit_nodes(edges, none), edges)
    assert nodes.agg(F.sum("degree")).first()[0] == 2 * edges.count()


def test_consolidation_is_idempotent_over_partitions(spark):
    rows = [("c", i % 2, i, f"N{i % 5}", None if i % 3 else f"name {i}", "person" if i % 4 else "city", "x" * (i % 6)) for i in range(50)]
    records = spark.createDataFrame(rows, "case_id string, source_ord int, row_ord int, entity_name string, label string, entity_type string, description string")
    once = sorted(map(str, consolidate.consolidate_nodes(records.repartition(7)).collect()))
    assert once == sorted(map(str, consolidate.consolidate_nodes(records.coalesce(1)).collect()))


def test_deletion_leaves_no_dangling_chunk(spark):
    doomed = spark.createDataFrame([("c", "d1"), ("c", "d2")], "case_id string, document_id string")
    chunks = spark.createDataFrame([("c", "d1", "k1", "a1", "s1<SEP>s2"), ("c", "d3", "k3", None, None)], "case_id string, document_id string, chunk_id string, alias string, source_id string")
    status = spark.createDataFrame([("c", "d1", "k0")], "case_id string, document_id string, chunk_id string")
    tokens = integrity.document_tokens(doomed, status, chunks)
    vectors = spark.createDataFrame(
        [("c", "v1", None, "k1", None, "p"), ("c", "v2", None, "s2;k3", None, "p"), ("c", "v3", None, "k3", None, "p"), ("c", "v4", "d1", None, None, "p"), ("c", "v5", None, None, None, "gone"), ("c", "k0", None, None, None, "p")],
        "case_id string, record_id string, document_id string, source_id string, chunk_id string, file_path string")
    paths = spark.createDataFrame([("c", "d1", "p"), ("c", "d2", "gone")], "case_id string, document_id string, file_path string")
    left = integrity.delete_vectors(vectors, doomed, tokens, paths)
    assert {r.record_id for r in left.collect()} == {"v3"}
    assert {r.record_id for r in integrity.delete_vectors(vectors, doomed, tokens, paths, keep_if_supported=True).collect()} == {"v2", "v3"}


def test_model_hook_retries_and_keeps_errors(spark, tmp_path):
    rows = spark.createDataFrame([("1", "fine"), ("2", "bad")], "key string, text string")

    def fn(text):
        if text == "bad":
            raise RuntimeError("no")
        return text.upper()

    got = {r.key: (r.reply, r.attempts, r.error) for r in mm.model_map(rows, fn, window_seconds=3.5, sleep=lambda s: __import__("time").sleep(s / 2)).collect()}
    assert got["1"] == ("FINE", 1, None)
    assert got["2"][0] is None and got["2"][1] > 1 and got["2"][2] == "RuntimeError: no"


def test_every_source_is_exported(spark):
    from caseloom.sources import sinks

    rows = [("c", "edge", "e", "a.txt", f"r{i:05d}") for i in range(10_001)]
    evidence = spark.createDataFrame(rows, "case_id string, owner_kind string, owner_key string, file_path string, reference_id string")
    nodes = spark.createDataFrame([("c", "e", "E", None, None)], "case_id string, node_id string, label string, entity_type string, summary string")
    entity = evidence.withColumn("owner_kind", F.lit("entity"))
    assert sinks.entity_rows(nodes, entity).first().sources.count(" | ") == 10_000


def test_next_value_of_a_hot_key(spark):
    from caseloom.session import with_next

    rows = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = {r.id: r.n for r in with_next(rows, ["k"], ["id"], "id", "n").collect()}
    assert all(n == (i + 3 if i % 3 == 0 and i + 3 < 500 else None) for i, n in got.items())


def test_contained_spans_of_every_length(spark):
    import random

    from caseloom.operators.containment import containing_pairs

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab c") for _ in range(n)) for n in (0, 1, 3, 15, 16, 17, 60, 200)] + ["long words without anything in common é漢"]
    spans = sorted({t[a:a + n] for t in texts for n in (1, 2, 3, 4, 5, 15, 16, 17, 40) for a in range(0, len(t), 7)} | {"zzz", "abababababababababab"})
    t = spark.createDataFrame([("k", i, x) for i, x in enumerate(texts)], "key string, text_id int, text string")
    s = spark.createDataFrame([("k", i, x) for i, x in enumerate(spans)], "key string, span_id int, span string")
    got = {(r.text_id, r.span_id) for r in containing_pairs(t, s, ["key"]).collect()}
    assert got == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(spans) if y and y in x}


def test_streams_pass_over_what_they_have(spark, tmp_path):
    from caseloom.streaming import flows

    def run(start, rows, schema, name):
        folder = tmp_path / name / "in"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        start(spark.readStream.schema(schema).parquet(str(folder)), str(tmp_path / name / "out"), str(tmp_path / name / "check")).awaitTermination()

    from caseloom.operators.text_index import TextIndex

    segment = "case_id string, document_id string, source_kind string, segment_key string, content string, original_filename string"
    index = lambda stream, path, check: flows.index_new_segments(stream, TextIndex(spark, path), check)
    for part in (["a", "b", "b"], ["b", "c"]):
        run(index, [("c", d, "raw", "raw", f"word {d}", f"{d}.txt") for d in part], segment, "index")
    found = TextIndex(spark, str(tmp_path / "index/out")).postings().filter("term = 'word'").collect()
    assert sorted(r.segment_id for r in found) == ["a|raw|raw", "b|raw|raw", "c|raw|raw"] and {len(r.positions) for r in found} == {1}
    document = "case_id string, document_id string, file_name string, mime_type string, profile string, content string, claimed_hash string, allow_duplicate boolean, created_ord long"
    for part in ([("1", "same"), ("2", "other")], [("3", "same"), ("4", "new")]):
        run(flows.intake, [("c", d, f"{d}.txt", "text/plain", "p", text, None, False, int(d)) for d, text in part], document, "intake")
    assert sorted(r.document_id for r in spark.read.parquet(str(tmp_path / "intake/out")).collect()) == ["1", "2", "4"]


def test_first_json_object():
    from caseloom.functions.text import _json_object

    assert _json_object('{oops} {"a": {"b": 1}}') == '{"a": {"b": 1}}'
    assert _json_object('say {"a": {"b": 1}} then {"c": 2}') == '{"a": {"b": 1}}'
    assert _json_object("```json\n{\"x\": 1}\n```") == '{"x": 1}' and _json_object("none { here") is None and _json_object(None) is None
