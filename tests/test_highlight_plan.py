"""A highlighted part of the graph is planned from tables, not from all that led to them."""

from caseloom.operators import views

NODES = [("c", "a", "Ann", 3), ("c", "b", "Bob", 2), ("c", "d", "a", 1), ("e", "z", "Zoe", 0)]
EDGES = [("c", "a", "b", "e1"), ("c", "b", "d", "e2")]


def parts(spark, asked):
    nodes = spark.createDataFrame(NODES, "case_id string, node_id string, label string, degree long")
    edges = spark.createDataFrame(EDGES, "case_id string, src_id string, tgt_id string, edge_id string")
    entities = spark.createDataFrame([("q1", "c", "a"), ("q2", "e", "nobody"), ("q1", "c", "")], "query_id string, case_id string, name string")
    relations = spark.createDataFrame(asked, "query_id string, case_id string, src_id string, tgt_id string, edge_id string")
    return views.highlight_subgraph(nodes, edges, entities, relations)


def test_plan_is_small(spark, capsys):
    for part in parts(spark, [("q1", "c", "a", "b", None)]):
        part.explain()
        assert capsys.readouterr().out.count("Exchange ") <= 12


def test_names_labels_and_ids_are_hit_once(spark):
    nodes, edges = parts(spark, [("q1", "c", "a", "b", "e1"), ("q1", "c", "x", "y", "e2")])
    assert sorted((r.query_id, r.rank, r.node_id) for r in nodes.collect()) == [("q1", 1, "a"), ("q1", 2, "b"), ("q1", 3, "d"), ("q2", 1, "z")]
    assert [(r.query_id, r.rank, r.edge_id) for r in edges.orderBy("rank").collect()] == [("q1", 1, "e1"), ("q1", 2, "e2")]
