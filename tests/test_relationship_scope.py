"""Counts of relationships come from one look at the edges in scope."""

from caseloom.operators import views


def test_scope_is_joined_once(spark):
    nodes = spark.createDataFrame([(c, n, n, "person", "") for c in ("k", "other") for n in "abcd" if (c, n) != ("other", "a")],
                                  "case_id string, node_id string, label string, entity_type string, summary string")
    edges = spark.createDataFrame([
        ("k", "e1", "a", "b", "PAID", "paid", None), ("k", "e2", "b", "c", "PAID", "paid", "1999-01-01"), ("k", "e3", "c", "d", "PAID", "paid", None),
        ("other", "e4", "b", "c", "KNOWS", "met", "1999-01-01"), ("other", "e5", "c", "d", "PAID", None, None)],
        "case_id string, edge_id string, src_id string, tgt_id string, relation_type string, label string, timestamp string").selectExpr("*", "cast(null as string) as raw_phrase")
    options = dict(categories=["paid"], keyword="pa", year_min=2000, actor="a", max_hops=2)
    counts = views.relationship_counts(nodes, edges, **options)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    # the edge of 1999 fails the year, the one without a label the keyword
    assert {r.case_id: tuple(r)[1:5] for r in counts.collect()} == {"k": (4, 3, 2, 1), "other": (3, 2, 2, 0)}
    assert [(r.edge_id, r.rank, r.actor) for r in views.relationships(nodes, edges, limit=5, **options).collect()] == [("e1", 1, "a")]
