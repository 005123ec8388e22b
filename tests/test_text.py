"""Small literal cases of text, vocabulary and preparation rules."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as tx, vocabulary as voc
from caseloom.operators import search as fts, textprep as tp
from caseloom.operators.containment import containing_pairs
from caseloom.operators.goldens import spans_in_sources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vocabulary_has_every_word():
    words = voc.relation_vocabulary()
    assert len(words) == 234
    assert words["member_of"] == "OWNS" and words["paid"] == "PAID" and words["director_of"] == "EMPLOYED_BY" and words["met"] == "MET_WITH"


def test_relation_scores(spark):
    r = one(spark, voc.normalise_relation(F.array(F.lit(None).cast("string"), F.lit(" "))))
    assert (r.relation_type, r.raw_phrase, r.confidence_score, r.confidence_band) == ("ASSOCIATED_WITH", None, 0.4, "low")
    r = one(spark, voc.normalise_relation(F.array(F.lit("director of"), F.lit("met"))))
    assert (r.relation_type, r.confidence_score, r.confidence_band) == ("EMPLOYED_BY", 0.72, "medium")


@pytest.mark.parametrize("text, want", [("on 2024-02-30, 2024/03/01", "2024-03-01"), ("1/2/69", "2069-01-02"), ("1-2-70", "1970-01-02"), ("nothing", None), ("13/1/2020", None)])
def test_dates(spark, text, want):
    assert one(spark, tx.first_date(F.lit(text))) == want


def test_low_value_images_are_dropped(spark):
    def image(description, seen):
        return one(spark, tp.image_text(F.lit(description), F.lit(seen), F.lit(None).cast("string")))

    assert image("A stylized letter on a map", "none") is None
    assert image("Aerial view of a street", "EXIT, exit\nPause") == "Image labels: EXIT\nVisual depiction: Aerial view of a street"
    assert image("A cat", "") is None


def test_inferred_triple(spark):
    texts = spark.createDataFrame([("c", "ALICE,123,shareholder of,BOB HOLDINGS LTD.,456")], "case_id string, text string")
    row = tp.infer_triples(texts).first()
    assert (row.src_id, row.tgt_id, row.relation_id) == ("ALICE", "BOB HOLDINGS LTD", "ALICE__MEMBER_OF__BOB HOLDINGS LTD")


def test_coalesced_blocks_keep_headings_apart(spark):
    texts = ["Heading", "One two three.", "Four five six.", "Table: x", "Seven eight nine ten.", "Eleven."]
    blocks = spark.createDataFrame([("c", "d", i, t) for i, t in enumerate(texts)], "case_id string, document_id string, block_no int, text string")
    out = [r.text for r in tp.coalesce_blocks(blocks, target_tokens=8, max_tokens=9).orderBy("window_no").collect()]
    assert out == ["Heading", "One two three.\nFour five six.", "Table: x", "Seven eight nine ten.\nEleven."]


def test_json_depth(spark):
    depth = {t: one(spark, tp.json_depth(F.lit(t))) for t in ('{"a": {"b": [1]}}', "{}", "[[], 1]", '"{["', "{bad")}
    assert depth == {'{"a": {"b": [1]}}': 4, "{}": 1, "[[], 1]": 2, '"{["': 1, "{bad": None}


def test_search_scopes_cases_and_marks_hits(spark):
    rows = [("a", "d1", "raw", "raw", "Alpha ledger transfer between shell companies.", "x.txt"), ("b", "d2", "raw", "raw", "nothing here", "y.txt"),
            ("a", "d3", "processed", "chunk-1", "Processed analysis mentions Orion Holdings and a wire transfer.", "z.txt")]
    segments = spark.createDataFrame(rows, "case_id string, document_id string, source_kind string, segment_key string, content string, original_filename string")
    queries = spark.createDataFrame([("1", "a", "ledger", "raw"), ("2", "a", "ledger", "processed"), ("3", "b", "ledger", "all"), ("4", "a", "orion wire", "all"), ("5", "a", "ledger zebra", "all")],
                                    "query_id string, case_id string, query string, source string")
    hits = fts.search(fts.build_postings(segments), segments, queries)
    assert {(r.query_id, r.document_id, r.segment_key) for r in hits.collect()} == {("1", "d1", "raw"), ("4", "d3", "chunk-1")}
    parts = {r.query_id: [(p.text, p.match) for p in r.snippet_parts] for r in fts.snippets(hits, segments, queries).collect()}
    assert ("ledger", True) in parts["1"] and ("Orion", True) in parts["4"] and ("wire", True) in parts["4"]


def test_containment_equals_brute_force(spark):
    texts = ["a bc def ghi jk lm no pq rs tu", "xa bcx", "ab", "c", "the end of the line", "one two three", ""]
    spans = ["bc def ghi", "a bc", "a", "b", "end of the lin", "ne two thre", "zzz", "c def ghi jk lm no pq rs t", "of the", "ab"]
    t = spark.createDataFrame([("k", i, s) for i, s in enumerate(texts)], "k string, text_id int, text string")
    s = spark.createDataFrame([("k", i, x) for i, x in enumerate(spans)], "k string, span_id int, span string")
    got = {(r.text_id, r.span_id) for r in containing_pairs(t, s, ["k"]).collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(spans) if b in a}


def test_spans_with_gaps_must_follow_each_other(spark):
    t = spark.createDataFrame([("k", 1, "He said “yes” – then left the old house quickly.")], "k string, text_id int, text string")
    s = spark.createDataFrame([("k", 1, 'said "yes" - then'), ("k", 2, "He said ... left the old house"), ("k", 3, "left the old ... He said"), ("k", 4, "ﬁnd")], "k string, span_id int, span string")
    assert {r.span_id for r in spans_in_sources(t, s, ["k"], True).collect()} == {1, 2}
