"""Byte-level BPE against the public library and the pattern itself."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from caseloom.llm import byte_bpe, queries
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = " \n\t 　'strevmldaZ09é中!?\"́\U0001F600\x1c\x85_-²Ⅷ"


@pytest.fixture(scope="module")
def model():
    return byte_bpe.RankModel(PATH)


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def test_query_equals_library(spark, library):
    got = {r.doc_id: r for r in queries.op11_byte_bpe(spark, brute.SF).collect()}
    rows = spark.read.parquet(f"{brute.SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_pieces_and_ids_of_random_texts(model, library):
    rng = random.Random(1)
    for _ in range(400):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(20)]
        pieces, borders = byte_bpe.split_pieces(pa.array(texts))
        pieces = [p.decode() for p in pieces.to_pylist()]
        assert [pieces[a:b] for a, b in zip(borders, borders[1:])] == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
        assert model.encode(pa.array(texts)).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_kind_of_every_code_point(library):
    """A pair of one character and a letter, digit or mark is one piece exactly where the library merges across them."""
    ranks = {bytes([i]): i for i in range(256)}
    for follower in b"a1!":
        for i in range(256):
            ranks.setdefault(bytes([i, follower]), len(ranks))
    judge = tiktoken.Encoding("kinds", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kinds = byte_bpe.kind_table()
    followers = {byte_bpe.LETTER: "a", byte_bpe.NUMBER: "1", byte_bpe.OTHER: "!"}
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and p != 0x20 and (p < 0x3400 or p % 3 == 0)]
    for kind, follower in followers.items():
        for p in points:
            together = judge.encode_ordinary(chr(p) + follower)[-1] >= 256
            assert together == (kinds[p] == kind), hex(p)


def test_long_piece(model, library):
    text = "ab" * 50_000 + "é" * 5_000
    assert model.encode(pa.array([text])).to_pylist() == [library.encode_ordinary(text)]


def test_forgetting_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBER", 5)
    small = byte_bpe.RankModel(PATH)
    texts = [f"qzx{i} wvk{i} qzx{i}" for i in range(30)]
    for a in range(0, 30, 3):
        assert small.encode(pa.array(texts[a:a + 3])).to_pylist() == [library.encode_ordinary(t) for t in texts[a:a + 3]]


def test_defined_results(spark, library):
    long = "many words and 12345 marks!! " * 40_000
    rows = [(0, None, "x", "i"), (1, "", "x", "i"), (2, " ", "x", "i"), (3, "it's", "x", "i"), (3, "it's", "x", "i"), (None, "a\n\n b", "x", "i"), (4, long, "x", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd name.x` string, decoded string")
    coded = byte_bpe.encode(docs, PATH)
    assert coded.columns == [*docs.columns, "ids"]
    back = byte_bpe.decode(coded, PATH)
    got = back.collect()
    assert sorted(back.columns) == sorted(["doc_id", "text", "odd name.x", "ids", "decoded"])
    assert len(got) == len(rows) and all(r["odd name.x"] == "x" for r in got)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH), PATH).collect() == []
    none = spark.createDataFrame([(None,), ([],), ([72, 1],)], "ids array<int>")
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode(none, PATH).collect()) == [b"", b"", library.decode_bytes([72, 1])]
    with pytest.raises(Exception, match="outside the rank file"):
        byte_bpe.decode(spark.createDataFrame([([50_256],)], "ids array<int>"), PATH).collect()
