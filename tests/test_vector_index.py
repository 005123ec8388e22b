import numpy as np
import pytest

from caseloom.functions.vectors import unit_rows
from caseloom.operators import retrieve as rt, vector_index as vi


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 10)) * 4
    rows = [("a" if i % 4 else "b", f"v{i}", (middles[i % 30] + rng.normal(size=10)).tolist()) for i in range(3000)]
    rows += [("a", "zero", [0.0] * 10), ("a", "copy", rows[1][2])]
    return spark.createDataFrame(rows, "case_id string, item_id string, vector array<double>").repartition(6).cache()


def asked(vectors):
    return vectors.filter("item_id rlike '0$' or item_id = 'zero'").selectExpr("concat('q', item_id) as query_id", "case_id", "vector")


def test_recall_and_exact_scores(spark, clustered):
    index = vi.build(clustered)
    assert index.codes.count() == clustered.count() and index.quantiser.words.shape == (3, 256, 4)
    exact = rt.vector_topk(asked(clustered), clustered, 10, 0.2).cache()
    near = vi.approximate_topk(index, asked(clustered), 10, 0.2).cache()
    r = vi.recall(near, exact).first()
    assert r.hits >= 0.95 * r.wanted > 0
    # clustered vectors need few of the lists
    assert index.quantiser.probes <= 0.4 * len(index.quantiser.centres)
    scores = {(x.query_id, x.item_id): x.score for x in exact.collect()}
    assert all(abs(scores[k] - x.score) < 1e-8 for x in near.collect() if (k := (x.query_id, x.item_id)) in scores)


def test_everything_probed_is_exact(spark, clustered, monkeypatch):
    monkeypatch.setattr(vi, "PART_ROWS", 37)
    monkeypatch.setattr(vi, "BLOCK_QUERIES", 11)
    monkeypatch.setattr(vi, "CELLS", 100)
    index = vi.build(clustered, vi.train(clustered, sample=400))
    full = vi.approximate_topk(index, asked(clustered), 5, 0.2, probes=len(index.quantiser.centres), shortlist=1000)
    rows = lambda df: sorted((r.query_id, r.rank, r.item_id, round(r.score, 7)) for r in df.collect())
    assert rows(full) == rows(rt.vector_topk(asked(clustered), clustered, 5, 0.2))


def test_small_and_empty(spark, clustered):
    few = clustered.filter("item_id in ('v1', 'v2', 'copy')")
    hits = vi.approximate_topk(vi.build(few), few.selectExpr("item_id as query_id", "case_id", "vector"), 3, 0.99)
    assert {(r.query_id, r.item_id) for r in hits.collect()} >= {("v1", "copy"), ("copy", "v1"), ("v2", "v2")}
    none = clustered.filter("false")
    assert vi.approximate_topk(vi.build(none), few.selectExpr("item_id as query_id", "case_id", "vector"), 3, 0.2).collect() == []


def test_centres_are_means():
    rows = unit_rows(np.random.default_rng(1).normal(size=(400, 6)))
    centres = vi.k_means(rows, 12, 3)
    own, away = vi.nearest(rows, centres)
    assert np.allclose(away, ((rows - centres[own]) ** 2).sum(axis=1)) and len(np.unique(own)) == 12


def test_queries_are_sent_once_per_part(spark, clustered, monkeypatch):
    index = vi.build(clustered, vi.train(clustered, sample=400))
    sent, own = [], vi.cut_lineage
    monkeypatch.setattr(vi, "cut_lineage", lambda df: sent.append(own(df)) or sent[-1])
    monkeypatch.setattr(vi, "CELLS", 5000)
    met = vi.shortlists(index, asked(clustered), 3000, probes=4)
    # all probed lists of a query lie in one part, so it goes there once and not once per list
    assert sent[0].count() == asked(clustered).count()
    # and what it meets there are its probed lists, whole
    lists = {}
    for r in index.codes.collect():
        lists.setdefault((r.case_id, r.list), set()).add(r.item_id)
    want = set()
    for r in asked(clustered).collect():
        away = ((index.quantiser.units([r.vector]) - index.quantiser.centres) ** 2).sum(axis=1)
        want |= {(r.query_id, i) for l in np.argsort(away, kind="stable")[:4] for i in lists.get((r.case_id, int(l)), ())}
    assert {(r.query_id, r.item_id) for r in met.filter("query_id <> 'qzero'").collect()} == {w for w in want if w[0] != "qzero"}
