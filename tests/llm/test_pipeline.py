"""The pipeline, stage by stage on its own input, against brute force."""

import pytest

import corpus_pipeline
from caseloom.session import cut_lineage
from tests.llm import brute


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(cut_lineage(stage(spark, made[-1], brute.SF)))
    return made


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_keeps_clean_documents(tables):
    assert set(rows(tables[0])) == set(rows(tables[1]))


def test_one_document_of_each_class_stays(tables):
    before = rows(tables[1])
    classes = brute.near_classes([(d, r.text) for d, r in before.items()])
    assert set(rows(tables[2])) == {d for d, c in classes.items() if d == c}


def test_repeated_passages_go(tables):
    before, after = rows(tables[2]), rows(tables[3])
    data = [(d, r.text) for d, r in before.items()]
    for (d, t), kept in zip(data, brute.passages(data)):
        assert after[d].text == (t if len(kept) == len(brute.words(t)) else " ".join(kept)) and after[d].n_chars == len(after[d].text)


def test_personal_data_goes(tables):
    before, after = rows(tables[3]), rows(tables[4])
    assert set(before) == set(after)
    for d, r in after.items():
        assert not brute.personal(r.text) and (brute.personal(before[d].text) or r.text == before[d].text)


def test_run_packs_every_document(spark, tables):
    got = {r.doc_id for r in corpus_pipeline.run(spark, brute.SF).select("doc_id").collect()}
    assert got == set(rows(tables[4]))
    assert all(t.columns == tables[0].columns for t in tables[1:5])
