"""Merging the agencies of a small case, and order-dependent acceptance against a sequential model."""

import random

from pyspark.sql import functions as F

from caseloom.operators import naming, resolve as er


def _case(spark):
    names = ["DHS", "Department of Homeland Security", "Departement of Homeland Security", "DHS Office of Inspector General Report", "ICE"]
    nodes = spark.createDataFrame([("c", n, n, "organization", None) for n in names], "case_id string, node_id string, label string, entity_type string, summary string")
    edges = spark.createDataFrame(
        [("c", "e1", "DHS", "ICE", "SUPERVISES", "oversees", 0.8, None, 1.0), ("c", "e2", "Department of Homeland Security", "ICE", "SUPERVISES", "runs", 0.7, None, 2.0)],
        "case_id string, edge_id string, src_id string, tgt_id string, relation_type string, label string, confidence_score double, timestamp string, weight double")
    return nodes, edges


def test_candidates_find_acronym_and_misspelling(spark):
    pairs = {(r.first_id, r.second_id, r.reason, r.common_neighbours) for r in er.candidate_pairs(*_case(spark)).collect()}
    assert ("DHS", "Department of Homeland Security", "acronym", 1) in pairs
    assert ("Departement of Homeland Security", "Department of Homeland Security", "one_edit", 0) in pairs


def test_merge_leaves_one_edge_and_no_source(spark):
    nodes, edges = _case(spark)
    proposals = spark.createDataFrame(
        [("c", 1, "DHS", "Department of Homeland Security", 0.9), ("c", 2, "ICE", "ICE", 0.99), ("c", 3, "ICE", "DHS", 0.95), ("c", 4, "ICE", "Nobody", 0.95)],
        "case_id string, ord long, source string, target string, confidence double")
    none = spark.createDataFrame([], "case_id string, source string, target string")
    accepted = er.accept_proposals(proposals, nodes, none)
    roots = er.merge_roots(accepted)
    assert [(r.source, r.root) for r in roots.collect()] == [("DHS", "Department of Homeland Security")]
    merged = er.merge_edges_after(edges, roots).collect()
    assert [(e.src_id, e.tgt_id, e.label, e.weight) for e in merged] == [("Department of Homeland Security", "ICE", "oversees", 2.0)]
    assert "DHS" not in {r.node_id for r in er.merge_nodes(nodes, roots).collect()}


def test_acceptance_equals_working_in_order(spark):
    rng = random.Random(7)
    ids = [f"n{i}" for i in range(12)]
    rows = [("c", i, rng.choice(ids), rng.choice(ids), 0.9) for i in range(60)]
    merged, want = set(), []
    for case, i, s, t, _ in rows:
        if s != t and s not in merged and t not in merged:
            merged.add(s)
            want.append(i)
    nodes = spark.createDataFrame([("c", i, i, "person", None) for i in ids], "case_id string, node_id string, label string, entity_type string, summary string")
    proposals = spark.createDataFrame(rows, "case_id string, ord long, source string, target string, confidence double")
    none = spark.createDataFrame([], "case_id string, source string, target string")
    accepted = er.accept_proposals(proposals, nodes, none)
    assert sorted(r.ord for r in accepted.collect()) == want
    targets = {r.source: r.target for r in accepted.collect()}

    def end(x):
        while x in targets:
            x = targets[x]
        return x

    assert {r.source: r.root for r in er.merge_roots(accepted).collect()} == {s: end(s) for s in targets}


def test_type_prefix_repairs_the_type(spark):
    row = spark.range(1).select(er.repaired_type(F.lit("[ORGANIZATION] ACME LTD"), F.lit("person")).alias("t")).first()
    assert row.t == "organization"


def test_names_stay_unique_when_one_looks_like_a_variant(spark):
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("a-2", 3), ("a", 4)], "slug string, ord long")
    out = naming.allocate_slugs(requests, spark.createDataFrame([("a-4",)], "slug string")).collect()
    assert {r.ord: r.unique_slug for r in out} == {1: "a", 2: "a-3", 3: "a-2", 4: "a-5"}
