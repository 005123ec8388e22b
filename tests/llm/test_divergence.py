"""Shares and differences against brute force; the whole query against SQL is in test_operators."""

import random
import re
from collections import Counter, defaultdict

import pytest

from caseloom.llm import divergence

TERMS = re.compile(divergence.TERM)


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERMS.findall(text or "")]


def brute(rows, least, top):
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        in_docs[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    out = []

    def ranked(lang, source, part, found, most=None):
        found.sort(key=lambda x: (-x[1], x[0].encode()))
        out.extend((lang, source, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1))

    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        v = len(kept)
        n = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10 ** 9 * (c + 5) // (sum(per.values()) + 5 * v) for t, c in per.items()} for s, per in n.items()}
        for s in sources:
            ranked(lang, s, "pair", [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s])
            ranked(lang, s, "term", [(t, p[s][t] - p[None][t]) for t in kept if n[s][t] and p[s][t] > p[None][t]], top)
    return sorted(out)


@pytest.mark.parametrize("least,top,cells", [(30, 50, 1 << 20), (3, 4, 16), (1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, least, top, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    rng = random.Random(least)
    forms = ["{}", "{},", "({})", "{}-{}", "{}.", "«{}»", "{}1{}"]
    rows = []
    for i in range(150):
        vocabulary = [f"{c}{d}" for c in "abcDEé" for d in "xyZ中"]
        text = " \t\n".join(rng.choice(forms).format(*rng.choices(vocabulary, k=2)) for _ in range(rng.randint(0, 12)))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", None, ""]), text))
    rows += [("fr", "a", None), ("fr", "b", "1 2 3"), ("it", "only", "one"), ("en", "empty", ""), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, `odd name.x` string, n long").repartition(5)
    got = divergence.divergence(docs, least, top)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)


def test_terms_that_chunks_leave_open(spark):
    """Thirty documents hold the term, each as another chunk; two chunks of one document count once."""
    rows = [("en", "s", f"word{i}word {i}word") for i in range(29)] + [("en", "t", "word word, word.")]
    more = rows + [("en", "t", "(word)")]
    docs = lambda data: spark.createDataFrame(data, "lang string, source string, text string")
    assert [tuple(r) for r in divergence.divergence(docs(more), 31, 5).collect()] == brute(more, 31, 5) != []
    assert {r.value for r in divergence.divergence(docs(rows), 31, 5).collect()} == {0}


def test_long_text_and_empty_table(spark):
    rows = [("en", "s", "a" * 200_000 + " x" * 100_000), ("en", "t", "x")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.divergence(docs, 1, 5).collect()) == brute(rows, 1, 5)
    assert divergence.divergence(docs.limit(0)).collect() == []
