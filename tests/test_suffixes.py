import random

from caseloom.operators.suffixes import shortest_spans, spans_within, texts_around


def test_parts_of_short_texts_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abä ") for _ in range(rng.randint(0, n)))
    texts = {(k, word(14)) for k in "xyz" for _ in range(60)} | {("x", "aaaa"), ("only", "abc")}
    spans = {(k, word(4)) for k in "xyz" for _ in range(25)} | {("x", "a"), ("x", "aa"), ("x", "aaaaa"), ("none", "abc")}
    t = spark.createDataFrame(sorted(texts), "q string, text string").repartition(5)
    s = spark.createDataFrame(sorted(spans) * 2, "q string, span string").repartition(3)
    assert {tuple(r) for r in spans_within(t, s, ["q"]).collect()} == {(k, a) for k, a in spans if a and any(j == k and a in b for j, b in texts)}
    assert {tuple(r) for r in texts_around(t, s, ["q"]).collect()} == {(k, b) for k, b in texts if any(j == k and a and a in b for j, a in spans)}
    assert {tuple(r) for r in shortest_spans(s, ["q"]).collect()} == {
        (k, a) for k, a in spans if a and not any(j == k and b and b != a and a.startswith(b) for j, b in spans)}


def test_one_key_with_most_rows(spark):
    texts = spark.range(3000).selectExpr("if(id % 50 = 0, cast(id as string), 'hot') as q", "concat('file ', id, ' end') as text")
    spans = spark.range(0, 6000, 3).selectExpr("'hot' as q", "concat('ile ', id, ' ') as span")
    assert spans_within(texts, spans, ["q"]).count() == sum(i % 50 != 0 for i in range(0, 3000, 3))
