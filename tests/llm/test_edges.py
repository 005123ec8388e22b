"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns in every operator."""

import pytest
from pyspark.sql import functions as F

from caseloom.llm import fingerprints, language_id, near_dedup, packing, pii, quality, queries, secrets, sentencepiece, substring_dedup, toxicity
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, rest string, _row long, _windows string, spans string, bucket int, words string, `odd name.x` string"
LONG = " ".join(f"w{i % 9000}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "one", "1234 5678", "a b c d e f g h i j k l m n o", "a b c d e f g h i j k l m n o", LONG, LONG + " end", "é" * 5000, "password=abcdef123 x@y.zz +1 (988) 555-2485"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None if t is None else len(t), 0.5, "xx", "r", 7, "w", "s", 1, "q", "o") for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[7], (None, "a b c d e f g h i j k l m n o", None, None, None, None, None, None, None, None, None, None, None, None), (None,) * 14]
    return spark.createDataFrame(rows, SCHEMA).cache()


OPERATORS = {
    "language": lambda d: language_id.predict(d, language_id.fit(d, F.lit(True))),
    "passages": substring_dedup.deduplicated,
    "personal": pii.find_personal,
    "near": near_dedup.near_classes,
    "secrets": secrets.find_secrets,
    "fingerprints": fingerprints.fingerprints,
    "pieces": lambda d: sentencepiece.encode(d, queries.tokenizer_path("piece_bpe_32k.model")),
    "toxicity": lambda d: toxicity.toxicity(d, toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), F.lit(True))),
    "packing": lambda d: packing.pack_documents(d, queries.tokenizer_path("word_bpe_49k.json")),
    "quality": quality.quality,
}
STAGES = {"language": language_id.language_stage, "near": near_dedup.near_stage, "passages": substring_dedup.dedup_stage, "personal": pii.personal_stage}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd).collect()
    if name == "near":
        assert len(got) == sum(r.doc_id is not None for r in odd.collect())
    elif name == "packing":
        assert {p.doc_id for p in got} == {r.doc_id for r in odd.collect()}
    else:
        assert len(got) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(odd, name):
    got = STAGES[name](odd)
    assert got.columns == odd.columns and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    rows = got.collect()
    assert all(r.score in (0.5, None) and r.lang_pred in ("xx", None) and r["odd name.x"] in ("o", None) for r in rows)
    assert STAGES[name](odd.limit(0)).collect() == []


def test_defined_results(odd):
    language = {r.doc_id: r for r in OPERATORS["language"](odd).collect()}
    assert all((language[i].lang_pred, language[i].score) == ("und", 0.0) for i in (0, 1, 2, 4))
    kept = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.deduplicated(odd).collect()]
    assert kept.count((5, 15, 0)) == 2 and (6, 15, 15) in kept and (None, 15, 0) in kept and (0, 0, 0) in kept
    classes = {r.doc_id: r.class_id for r in near_dedup.near_classes(odd).collect()}
    assert classes[6] == classes[5] == 5 and classes[8] == classes[7] == 7 and [classes[i] for i in (0, 1, 2, 3)] == [0, 1, 2, 3]
    prints = {r.doc_id: r for r in fingerprints.fingerprints(odd).collect()}
    assert prints[0].fingerprint == prints[1].fingerprint == prints[2].fingerprint == "" and prints[5].fingerprint == prints[6].fingerprint != ""
    assert prints[1].near_next == 1.0 and prints[3].near_next == 0.0 and prints[6].near_next == 1.0
    packed = [(p.doc_id, p.length) for p in OPERATORS["packing"](odd).collect()]
    assert packed.count((0, 1)) == 1 and packed.count((1, 1)) == 1
    q = {r.doc_id: r for r in quality.quality(odd).collect()}
    assert q[0].n_words == 0 and q[0].base_failed and not q[0].kept and q[7].n_words == 30_000
    found = {r.doc_id: r for r in pii.find_personal(odd).collect()}
    assert (found[10].n_email, found[10].n_phone, found[0].spans) == (1, 1, "")


def test_toxicity_without_a_class_is_zero(spark, odd):
    none = odd.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert toxicity.fit(odd, none, F.lit(True)) is None
    assert {r.score for r in toxicity.toxicity(odd, None).collect()} == {0.0}


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    for op in (substring_dedup.deduplicated, near_dedup.near_classes, fingerprints.fingerprints, pii.find_personal):
        assert sorted(map(str, op(docs.repartition(7)).drop("text").collect())) == sorted(map(str, op(docs.coalesce(1)).drop("text").collect()))


def test_chains_of_links_are_one_class(spark):
    """Each text is alike to the next one only; the class is the whole chain."""
    base = [f"w{i}" for i in range(400)]
    data = [(d, " ".join(f"v{i}" if i < 10 * d else w for i, w in enumerate(base))) for d in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == brute.near_classes(data) == {d: 0 for d in range(12)}
