"""A view without a focus looks at the ends of its edges once."""

import pytest

from caseloom.operators import views


@pytest.mark.parametrize("limit, shown", [(None, [("a", "b")]), (2, [("a", "b")]), (1, [])])
def test_ends_are_looked_up_once(spark, monkeypatch, limit, shown):
    nodes = spark.createDataFrame([("k", n, n, t, d) for n, t, d in [("a", "person", 3), ("b", "person", 2), ("c", "event", 1)]],
                                  "case_id string, node_id string, label string, entity_type string, degree int")
    edges = spark.createDataFrame([("k", "a", "b"), ("k", "a", "c"), ("k", "c", "b")], "case_id string, src_id string, tgt_id string")
    calls, own = [], views.both_ends
    monkeypatch.setattr(views, "both_ends", lambda *a: calls.append(1) or own(*a))
    found = views.graph_view(nodes, edges, limit=limit, entity_types=["Person"])[1]
    assert len(calls) == 1 and [(r.src_id, r.tgt_id) for r in found.collect()] == shown
