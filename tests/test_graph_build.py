"""The trade graph's edges are taken apart into their ends once."""

from caseloom.plans import bindings


def test_ends_are_counted_once(spark, monkeypatch):
    plans, own = [], bindings.cut_lineage
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(bindings, "cut_lineage", lambda df: plans.append(plan(df)) or own(df))
    sf = "/root/testdata/sf0.001"
    edges = own(bindings.trade_edges(spark, sf))
    nodes = bindings.trade_nodes(spark, sf, edges)
    assert sum(p.count("Generate explode") for p in [*plans, plan(nodes)]) == 1
    ends = edges.selectExpr("case_id", "explode(array(src_id, tgt_id)) as node_id").collect()
    found = {(r.case_id, r.node_id): r for r in nodes.collect()}
    assert nodes.count() == len(found) and {tuple(e) for e in ends} <= set(found)
    assert sum(r.degree for r in found.values()) == len(ends)
    assert {r.entity_type for k, r in found.items() if k[1].startswith("P:")} == {"object"}
