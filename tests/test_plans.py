"""No query may fall back to comparing everything with everything."""

import pytest

from caseloom.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["er_candidates", "fts_search", "eval_source", "span_in_source", "highlight_subgraph", "related_entities", "dup_reject", "mode_hybrid", "reference_resolve", "delete_cascade"]


@pytest.mark.parametrize("name", NAMES)
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from caseloom.operators.views import filter_edges
    from caseloom.plans.bindings import trade_graph

    _, edges = trade_graph(spark, SF)
    plan = filter_edges(edges, min_confidence=0.75).select("edge_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(confidence_score,0.75)" in plan and "ReadSchema: struct<confidence_score:double,edge_id:string>" in plan


def test_top_rows_are_pruned_before_the_shuffle(spark):
    from caseloom.operators.views import actor_counts
    from caseloom.plans.bindings import trade_graph

    plan = actor_counts(trade_graph(spark, SF)[0])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


@pytest.mark.parametrize("name", ["annotate", "delete_cascade", "evidence_by_chunk", "graph_view_types", "graph_view_confidence", "eval_relations", "vector_topk"])
def test_no_case_or_label_in_one_window(spark, name):
    import re

    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        keys = re.search(r"Window \[row_number.*\], \[(\w+)#\d+\],", line) or re.search(r"Window \[lead.*\], \[(\w+)#\d+\],", line)
        assert not keys or keys[1] not in ("case_id", "label") or "WindowGroupLimit" in plan, line[:200]
