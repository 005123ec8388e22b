"""Texts without an index are read once, in slices; only hits of asked phrases are written."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions.text import fold, fold_latin
from caseloom.operators import search as fts

SEGMENT = "case_id string, document_id string, source_kind string, segment_key string, content string, original_filename string"
TEXTS = ["The red_house, ÉTÉ! straße 1\x01a", "red house red  house\tété", "a house; red", "Größe ½ red hous", "“red” house — naïve ǅ", "été red house", "İstanbul \U0001d400 house", "x", None]
ASKED = ["red_ho", '"red house"', "red house", "ete", "stra", "a", "ist", "naive", '"red hous"', "x", "nothing", "", "house_red", "2_txt"]


def segments(spark, again=0):
    rows = [("c" if i % 3 else "d", str(i), "raw" if i % 2 else "processed", "a", t, f"{i}.txt" if i % 4 else None) for i, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame([*rows, *[rows[1]] * again], SEGMENT)


@pytest.mark.parametrize("again, asked", [(0, ASKED), (2, ["red house", "ete", "a"])])
def test_same_hits_as_with_postings(spark, monkeypatch, again, asked):
    monkeypatch.setattr(fts, "SLICE_CHARS", 40)
    monkeypatch.setattr(fts, "PHRASES_AT_ONCE", 4)
    queries = spark.createDataFrame([(f"{q}{c}", c, text, "all" if q % 2 else "raw") for c in "cd" for q, text in enumerate(asked)], "query_id string, case_id string, query string, source string")
    rows = segments(spark, again)
    want = fts.search(fts.build_postings(rows), rows, queries)
    got = fts.search_texts(rows, queries)
    plain = lambda df: sorted(tuple(r) for r in df.withColumn("score", F.round("score", 9)).select(sorted(df.columns)).fillna("").collect())
    assert plain(want) == plain(got) and len(plain(got)) > 9


def test_words_of_tasks_are_those_of_columns(spark):
    rows = segments(spark)
    want = rows.select("document_id", F.posexplode(fts.segment_words(F.col("original_filename"), F.col("content")))).filter("col <> ''")
    got = fts.build_postings(rows).select(F.split("segment_id", r"\|")[0], F.explode("positions"), "term")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_folded_latin(spark):
    letters = [chr(i) for i in range(1, 256)]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in letters], "c string").select(fold(F.col("c"))).collect()] == [fold_latin(c) for c in letters]


def test_ranges_are_found_where_the_text_is(spark, capsys):
    texts = spark.createDataFrame([("a", "ÉTÉ 𝐀x, red_house Red", "red x été"), ("b", "", "red"), ("c", "red", ""), ("d", None, "red"), ("e", "İred red", "red")], "key string, content string, query string")
    ranges = fts.match_ranges(texts)
    ranges.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert sorted(map(tuple, ranges.collect())) == [("a", 0, 3), ("a", 8, 17), ("a", 18, 21), ("e", 2, 5), ("e", 6, 9)]  # in the lower-case text
