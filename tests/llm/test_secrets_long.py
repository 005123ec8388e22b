"""Candidates of secrets: by definition on random texts, and in time on long ones."""

import random
import time

from caseloom.llm import secrets
from caseloom.llm.spans import overlaps


def plain(text, taken):
    """By definition: from every sensitive word on; of candidates with one end the longest."""
    found = {}
    for word in secrets.CONTEXT.finditer(text):
        stop = text.find("\n", word.end(), word.end() + secrets.REACH)
        limit = stop if stop >= 0 else word.end() + secrets.REACH
        for m in secrets.CANDIDATE.finditer(text, word.end()):
            s = m[0]
            if m.start() < limit and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and not overlaps(taken, *m.span()):
                found[m.end()] = min(found.get(m.end(), m.start()), m.start())
    return sorted((a, b) for b, a in found.items())


def test_candidates_by_definition():
    rng = random.Random(6)
    bits = ["token", "Secret", " ", "\n", "=", ": ", "abcdefgh", "12345678", "Q7", "/", "password=hunter22", "0123456789abcdef01234567", "AKIA" + "Z9" * 9, "x" * 17, "9" * 16, "é", "bearer"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        base = secrets.base_spans(text)
        assert secrets.candidates(text, base) == plain(text, base), text


def test_long_texts_of_sensitive_words():
    begun = time.time()
    assert secrets.candidates("token " * 800_000, []) == []
    assert len(secrets.candidates("token1" * 300_000, [])) == 1
    text = "token=abc123 " * 150_000 + "secret key0" + "Zx9" * 20
    assert len(secrets.candidates(text, secrets.base_spans(text))) == 1
    assert time.time() - begun < 60


def test_defined_results(spark):
    rows = [(0, None, "x"), (1, "", "x"), (2, "token: abcdef", "x"), (2, "token: abcdef", "x"), (None, "my secret is Zk3qP9vL2mX8bT5w here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [(r.doc_id, r.n_assign, r.spans) for r in secrets.find_secrets(docs).collect()]
    assert got.count((2, 1, "assign:0:13")) == 2 and (0, 0, "") in got and (1, 0, "") in got and (None, 0, "novel:13:29") in got
    assert secrets.find_secrets(docs.limit(0)).collect() == []
