"""Details travel as numbers: ids that follow from a row, texts of later lines and labels that nobody needs do not."""

import re

from pyspark.sql import functions as F

from caseloom.operators import consolidate, views
from caseloom.plans.graph_queries import line_edge_records, line_snippets, pair_snippets, supplier_snippets

SF = "/root/testdata/sf0.001"


def dealt(df, capsys):
    df.explain("formatted")
    return re.findall(r"\) Exchange.*?\nInput \[\d+\]: \[(.*?)\]\n", capsys.readouterr().out, re.S)


def graph(spark, ids):
    nodes = spark.createDataFrame([("c", k, l, "x") for k, l in [("a", "A"), ("b", "Same"), ("d", "same"), ("e", "Same")]], "case_id string, node_id string, label string, entity_type string")
    edges = spark.createDataFrame([("c", "a", t, "R", "l") for t in "bde"], "case_id string, src_id string, tgt_id string, relation_type string, label string")
    usual = consolidate.edge_id(F.col("src_id"), F.col("tgt_id"), F.col("relation_type"))
    return nodes, edges.withColumn("edge_id", usual if ids is None else F.concat(F.lit(ids), "tgt_id"))


def test_usual_edge_ids_do_not_travel(spark, capsys):
    rows = dealt(views.related_entities(*graph(spark, None)), capsys)
    assert rows and not any("edge_id" in row for row in rows)


def test_ties_go_by_edge_id_whatever_it_looks_like(spark):
    for ids in (None, "z-", "edge-"):
        nodes, edges = graph(spark, ids)
        want = [r.tgt_id for r in edges.orderBy("edge_id").collect()]
        rows = views.related_entities(nodes, edges, 2).filter("entity_id = 'a'").orderBy("rank").collect()
        assert [r.other_id for r in rows] == want[:2]
        assert {r.edge_id for r in rows} <= {r.edge_id for r in edges.collect()}


def test_first_lines_of_suppliers_and_pairs(spark):
    shown = line_snippets(spark, SF)
    want = {(r.case_id, r.owner_key): r.snippet for r in views.first_snippet(shown, "entity").collect()}
    assert want == {(r.case_id, r.owner_key): r.snippet for r in supplier_snippets(spark, SF).collect()}
    want = {(r.case_id, r.owner_key): r.snippet for r in views.first_snippet(shown, "pair").collect()}
    assert want == {(r.case_id, f"P:{r.l_partkey}|S:{r.l_suppkey}"): r.snippet for r in pair_snippets(spark, SF).collect()}


def test_pairs_meet_once_before_any_text(spark, capsys):
    keep = ("l_partkey", "l_suppkey")
    pairs = consolidate.pair_details(consolidate.edge_records(line_edge_records(spark, SF, keep), keep=keep), keep)
    rows = dealt(pairs.join(pair_snippets(spark, SF), ["case_id", *keep], "left"), capsys)
    assert rows and not any("src_id" in r or "label" in r or "snippet" in r or "file_path" in r for r in rows)


def test_a_pair_without_description_gets_labels(spark):
    nodes = spark.createDataFrame([("c", "a", "Ann"), ("c", "b", "Bob")], "case_id string, node_id string, label string")
    details = spark.createDataFrame([("c", "a", "b", " ", ["OWNS"], None, None, None, None), ("c", "b", "a", "known", ["OWNS"], None, None, None, "seen")],
        "case_id string, src_id string, tgt_id string, description string, relation_types array<string>, raw_phrase string, confidence_score double, confidence_band string, snippet string")
    rows = {r.src_id: r.description for r in views.relationship_details(nodes, details).collect()}
    assert rows == {"a": "Ann is linked to Bob through OWNS.", "b": "known Supporting evidence mentions: seen"}
