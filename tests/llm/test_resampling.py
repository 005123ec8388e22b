"""Hashed features, weights and the draw against brute force; the whole query against SQL is in test_operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from caseloom.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, most):
    w = words(text)
    return [zlib.crc32(" ".join(w[a:a + n]).encode()) for n in range(1, most + 1) for a in range(len(w) - n + 1)]


def brute(rows, target, most, buckets, percent, least, seed):
    s = Counter(c % buckets for _, t in rows for c in runs(t, most))
    t = Counter(c % buckets for x in target for c in runs(x, most))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_t * 0 + all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for d, x in rows:
        f = runs(x, most)
        weight = sum(gain[c % buckets] for c in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(enough[:percent * len(enough) // 100], 1):
        r[4] = k
    return sorted(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("most", [1, 2, 4])
def test_run_crcs(most):
    rng = random.Random(2)
    texts = [None, "", "  ", "Ab-cD é9 x", "x" * 100_000 + " tail of it", "zz"]
    texts += ["".join(rng.choice("aB9 é-\n_中@[`{~\U0001F600") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    crcs, n, n_words = resampling.run_crcs(texts, most)
    at = 0
    for text, k, w in zip(texts, n, n_words):
        assert w == len(words(text)) and crcs[at:at + k].tolist() == runs(text, most)
        at += k
    assert at == len(crcs)


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (2, 97)])
def test_whole_draw(spark, most, buckets):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(d, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for d in range(200)] + [(200, None), (201, ""), (202, "x" * 50_000)]
    target = [" ".join(rng.choices(vocabulary[:40], k=30)) for _ in range(20)] + [None]
    docs = spark.createDataFrame([(d, t, "k", 5) for d, t in rows], "doc_id long, text string, `odd name.x` string, weight long")
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resample(docs, aims, most, buckets, percent=15, least_words=20, seed=7)
    assert sorted(tuple(r) for r in got.drop("n_words").collect()) == brute(rows, target, most, buckets, 15, 20, 7)


def test_defined_results(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "few words")], "doc_id long, text string")
    nothing = spark.createDataFrame([], "text string")
    got = [tuple(r) for r in resampling.resample(docs, nothing, percent=100).drop("n_words").collect()]
    assert len(got) == 6
    by = {g[0]: g for g in got}
    assert by[2][1:3] == by[3][1:3] == (0, 0) and by[2][4] is by[3][4] is by[4][4] is None
    assert sorted(g[4] for g in got if g[1] == 25) == [1, 2, 3] and len({g[2] for g in got if g[1] == 25}) == 1
    assert resampling.resample(docs.limit(0), nothing).collect() == []
