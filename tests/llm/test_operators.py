"""Registered queries on the smallest tables against SQL, brute force, public libraries and held-out labels."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from caseloom.llm import fingerprints, near_dedup, packing, pii, queries, secrets, sentencepiece, substring_dedup
from tests.llm import brute
from tests.oracle import compare, connect

SF = brute.SF


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def result(spark):
    kept = {}

    def get(name):
        if name not in kept:
            kept[name] = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
        return kept[name]

    return get


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF) is None


def test_language_of_held_out_texts(rows, result):
    got = result("op1_language_id")
    held = [d for d, _, _ in rows if brute.fold(d, 4) == 2]
    assert [got[d].held_out for d, _, _ in rows] == [brute.fold(d, 4) == 2 for d, _, _ in rows]
    lang = {d: g for d, _, g in rows}
    assert np.mean([got[d].lang_pred == lang[d] for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_passages(rows, result):
    got = result("op2_substring_dedup")
    for (d, t, _), kept in zip(rows, brute.passages([r[:2] for r in rows])):
        assert (got[d].n_words, got[d].n_removed) == (len(brute.words(t)), len(brute.words(t)) - len(kept))
        assert got[d].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_automaton_finds_every_window():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 20):
        lists = [[str(x) for x in rng.integers(0, 3, rng.integers(4, 40))] for _ in range(size)]
        got = substring_dedup.first_documents([(w, d) for d, w in enumerate(lists)], 4)
        for words, firsts in zip(lists, got):
            for i, f in enumerate(firsts):
                assert f == min(d for d, w in enumerate(lists) if any(w[k:k + 4] == words[i:i + 4] for k in range(len(w) - 3)))


def test_frequent_anchors_go_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    monkeypatch.setattr(substring_dedup, "FREQUENT", 3)
    common = [f"w{i}" for i in range(20)]
    data = [(d, " ".join([f"a{d}", f"b{d}", *common, f"c{d}"])) for d in range(8)]
    got = {r.doc_id: r for r in substring_dedup.deduplicated(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for (d, _), kept in zip(data, brute.passages(data)):
        assert got[d].n_removed == 23 - len(kept)


def test_personal_data(rows, result):
    got = result("op3_pii")
    for d, t, _ in rows:
        base = brute.personal(t)
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        assert got[d].base_sha256 == brute.spans_digest(base, pii.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[d].spans.split(","))| (set() if base else {""})


@pytest.mark.parametrize("text", ["a@b@c.de x.y@z-.q..r", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.03.004", "4111 1111-1111 1111 4111111111111112", "+1 (988) 555-2485. ++49", "@.a@a.", "9" * 5000 + "." + "1.1.1"])
def test_base_patterns_on_odd_texts(text):
    assert sorted(pii.base_spans(text)) == sorted(brute.personal(text))


def test_field_carries_labels_to_repeated_tokens(spark):
    texts = [f"call +1 (98{i}) 555-24{i}5 or write ann.{i}@mail.example.com today" for i in range(10)]
    texts.append("call +1 (989) 555-2485 now; later 555-2485 again, room 555 and ann")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal(docs).collect()}
    at = texts[10].rindex("555-2485")
    assert f"phone:{at}:{at + 8}" in got[10].split(",")
    assert got[10].count("phone") == 2 and all(s.count(":") == 4 for i, s in got.items() if i < 10)
    assert pii.redact(texts[10], got[10]) == "call <PHONE> now; later <PHONE> again, room 555 and ann"


def test_messages_agree_with_enumeration():
    """On a graph without cycles loopy message passing is exact."""
    from itertools import product

    g = pii.Graph([(0, 1)] * 4, ["a", "b", "c", "d"], [0, 2, 0, 0], [(0, 1), (1, 2)], [(1, 3)])
    rng = np.random.default_rng(1)
    field = pii.Field({s: rng.normal(size=5) for s in "abcd"}, np.zeros(5), rng.normal(size=(5, 5)), 3.0)
    doubt = np.array([0] + [-pii.DOUBT] * 4)
    total = np.zeros((4, 5))
    for ys in product(range(5), repeat=4):
        score = sum(field.unary[s][y] + (pii.CLAMP * (y == given) if given else doubt[y]) for s, y, given in zip(g.shapes, ys, g.labels))
        score += sum(field.chain[ys[i], ys[j]] for i, j in g.chain) + sum(field.agree * (ys[i] == ys[j]) for i, j in g.skip)
        for i, y in enumerate(ys):
            total[i, y] += np.exp(score)
    assert np.allclose(pii.marginals(g, field), total / total.sum(axis=1, keepdims=True), atol=1e-2)


def test_near_classes(rows, result):
    got = result("op4_near_dedup")
    assert {d: r.class_id for d, r in got.items()} == brute.near_classes([r[:2] for r in rows])


def test_signatures_estimate_weighted_likeness():
    rng = np.random.default_rng(5)
    hits = []
    for n in (1, 3, 40, 3000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        counts = rng.integers(1, 4, n)
        other = np.where(rng.random(n) < 0.2, 0, counts)
        keep = other > 0
        if not keep.any():
            continue
        s = near_dedup.signatures([(a, counts), (a[keep], other[keep])])
        hits.append(abs((s[0] == s[1]).mean() - other.sum() / counts.sum()))
    assert max(hits) < 0.17


def test_secrets(rows, result):
    got = result("op5_secrets")
    for d, t, _ in rows:
        base = brute.secret(t)
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [sum(k == x for k, _, _ in base) for x in secrets.KINDS[:3]]
        assert got[d].base_sha256 == brute.spans_digest(base, secrets.KINDS)


def test_novel_strings_in_sensitive_context(spark):
    texts = ['auth_key <- "q7Zp0XvL2mTe9RwYb4Kd"', 'auth_key <- "configuration_value_1"', "the q7Zp0XvL2mTe9RwYb4Kd alone"]
    texts += ["private_key configuration_value_1 configuration_value_1"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.spans for r in secrets.find_secrets(docs, b"configuration_value_1 configuration value").orderBy("doc_id").collect()]
    assert got[:3] == ["novel:13:33", "", ""] and set(got[3:]) == {""}


def test_fingerprints(rows, result):
    got = result("op6_fingerprints")
    order = sorted(rows, key=lambda r: -r[0])
    for (d, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = brute.sketch(t), brute.sketch(edited), brute.sketch(nxt)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x % 2**64:016x}" for x in a) and r.edited_fingerprint == "".join(f"{x % 2**64:016x}" for x in b)
        assert r.near_edited == pytest.approx(brute.resemblance(a, b)) and r.near_next == pytest.approx(brute.resemblance(a, c))


def test_sketches_merge_and_estimate(spark):
    data = [(k, " ".join(f"t{i}" for i in range(k * 300, k * 300 + 900))) for k in range(3)]
    docs = spark.createDataFrame(data, "part long, text string").selectExpr("'all' as k", "part", "text").withColumn("sketch", fingerprints.sketch(fingerprints.F.col("text")))
    merged = fingerprints.merge_sketches(docs, ["k"])
    r = merged.select(fingerprints.distinct_count(fingerprints.F.col("sketch")).alias("n"), "sketch").first()
    every = sorted({h for _, t in data for h in brute.sketch(t, 10**6)})
    assert r.sketch == every[:128] and abs(r.n / len(every) - 1) < 0.3
    pair = docs.filter("part = 0").crossJoin(docs.filter("part = 1").selectExpr("sketch as other")).select(
        fingerprints.containment(fingerprints.F.col("sketch"), fingerprints.F.col("other")).alias("c")).first()
    assert abs(pair.c - 596 / 896) < 0.2


def test_pieces_are_the_models_own(spark, rows):
    import sentencepiece as library

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = library.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "  a  b ", "漢字 テスト\n\tx y", "😀 def f(x):\n    return  x\r\n", "<s> </s> <0x0A>", " lead", "trail ", "\n\n\n"]
    texts = [t for _, t, _ in rows] + odd
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepiece.decode(sentencepiece.encode(docs, path), path).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == model.encode(t or "") and got[i].decoded == (t or "")


def test_toxicity_of_held_out_texts(spark):
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (brute.fold(d, 5) == 0) for d, r in got.items())
    toxic = [got[d].score for d, y in labels.items() if got[d].held_out and y]
    clean = [got[d].score for d, y in labels.items() if got[d].held_out and not y]
    assert np.mean([[a > b for b in clean] for a in toxic]) > 0.9


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    pieces = queries.op9_packing(spark, SF).collect()
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t, _ in rows}
    seen, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert len(part) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        seen[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for d, all_ids in ids.items():
        at = 0
        for start, length in sorted(seen[d]):
            assert start == at
            at += length
        assert at == len(all_ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert sum(map(len, ids.values())) / (packing.LENGTH * len(sequences)) > 0.97


def test_first_fit_tree():
    rng = np.random.default_rng(2)
    lengths = sorted(rng.integers(1, 101, 500).tolist(), reverse=True)
    bins, offsets = packing.first_fit(lengths, 100)
    room = []
    for n, b, o in zip(lengths, bins, offsets):
        want = next((i for i, r in enumerate(room) if r >= n), len(room))
        if want == len(room):
            room.append(100)
        assert (b, o) == (want, 100 - room[want])
        room[want] -= n
