"""Byte-level BPE: texts part into pieces, a segment tree over a piece's bytes finds the leftmost pair of least rank.

Pieces are the matches of the rank files' pattern. It is applied to whole Arrow columns: every code point has one of four
kinds, and the borders of pieces follow from the kinds of neighbours. Distinct pieces are merged once per worker and
remembered; the ids of texts are gathered from flat arrays.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from caseloom.llm.frames import through_tasks

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Kinds of code points, as the pattern has them.
KINDS = {LETTER: r"\p{L}+", NUMBER: r"\p{N}+", SPACE: r"\s+"}
#: Endings that part from a word at an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes of text handled at a time; a single longer text is handled on its own.
CHUNK_BYTES = 1 << 22
#: A worker forgets its pieces when it has so many, or pieces of so many bytes.
REMEMBER, REMEMBER_BYTES = 300_000, 16 << 20
NO_PAIR = 1 << 62


def _library_kinds(points: np.ndarray) -> list[int]:
    """Kinds as the tokenizer library has them: its pattern keeps a character and a follower together if they are of one kind."""
    followers = {LETTER: b"a", NUMBER: b"1", OTHER: b"!"}
    pairs = [bytes([i]) + f for f in followers.values() for i in range(256)]
    ranks = {s: i for i, s in enumerate([bytes([i]) for i in range(256)] + pairs)}
    library = tiktoken.Encoding("kinds", pat_str="|".join([*KINDS.values(), r"[^\s\p{L}\p{N}]+"]), mergeable_ranks=ranks, special_tokens={})
    last = lambda p, f: library.encode_ordinary(chr(p) + f.decode())[-1]
    return [next((kind for kind, f in followers.items() if last(p, f) >= 256), SPACE) for p in points.tolist()]


@lru_cache(1)
def kind_table() -> np.ndarray:
    """Kind of every code point; where two Unicode versions at hand differ, the tokenizer library's own is asked."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), OTHER, dtype=np.uint8)
    for kind, pattern in KINDS.items():
        for run in regex.finditer(pattern, every):
            kinds[run.start():run.end()] = kind
    letter = {"L": LETTER, "N": NUMBER}
    other = np.fromiter((letter.get(unicodedata.category(c)[0], OTHER) for c in every), dtype=np.uint8, count=len(every))
    unsure = np.flatnonzero((kinds != other) & (kinds != SPACE))
    kinds[unsure] = _library_kinds(unsure)
    return kinds


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point of texts put together; first marks the first code point of every text.

    A run of one kind is a piece and takes one plain blank before it along. Of a run of white space before something
    else the last character parts; an apostrophe that starts its piece takes an ending along.
    """
    n = len(points)
    kinds = kind_table()[points]
    edge = first.copy()
    edge[1:] |= kinds[1:] != kinds[:-1]
    starts = edge.copy()
    solid = np.zeros(n + 1, dtype=bool)  # something other than white space that goes on from the character before
    solid[:n] = (kinds != SPACE) & ~first
    starts[np.flatnonzero((kinds == SPACE) & solid[1:])] = True
    led = np.zeros(n, dtype=bool)  # begins with the plain blank before it
    led[1:] = edge[1:] & solid[1:n] & (points[:-1] == 0x20)
    starts[led] = False
    marks = np.flatnonzero((points == ord("'")) & edge & ~led)
    ends = np.zeros(len(marks), dtype=np.int64)
    ahead = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
    new = np.concatenate([first, [True, True]])
    for ending in ENDINGS:
        fits = np.ones(len(marks), dtype=bool)
        for k, letter in enumerate(ending, 1):
            at = np.minimum(marks + k, n + 1)
            fits &= (ahead[at] == ord(letter)) & ~new[at]
        ends[fits] = marks[fits] + 1 + len(ending)
    held = ends > 0
    starts[marks[held] + 1] = False
    after = ends[held]
    starts[after[after < n]] = True
    return starts


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts in order, as bytes, and the number of pieces before each text, the total last."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    borders = np.concatenate([[0], np.cumsum(lengths)])
    if not borders[-1]:
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, dtype=np.int64)
    data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0])
    points = np.frombuffer(data.to_pybytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    first = np.zeros(len(points), dtype=bool)
    first[borders[:-1][lengths > 0]] = True
    at = np.flatnonzero(piece_starts(points, first))
    size = np.ones(len(points), dtype=np.int64)
    for least in (0x80, 0x800, 0x10000):
        size += points >= least
    byte_at = np.cumsum(size) - size
    cuts = np.append(byte_at[at], len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cuts), data])
    return pieces, np.searchsorted(at, borders, side="left")


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start:start + size] of all numbers one after the other, and the end of each."""
    sizes = size[numbers]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start[numbers] - (ends - sizes), sizes)], ends


class RankModel:
    """Ranks of byte strings, and the pieces a worker has merged so far."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        most = max(self.ranks.values()) + 1
        self.known_id = np.zeros(most, dtype=bool)
        self.known_id[list(self.ranks.values())] = True
        strings = [b""] * most
        for string, i in self.ranks.items():
            strings[i] = string
        self.bytes_of = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.bytes_size = np.fromiter(map(len, strings), dtype=np.int64, count=most)
        self.bytes_start = np.cumsum(self.bytes_size) - self.bytes_size
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.flat = np.zeros(0, dtype=np.int32)
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. Leaf i of the tree is the pair that starts at byte i: its rank, and i for the leftmost of equals."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        leaves = 1
        while leaves < n:
            leaves *= 2
        tree = [NO_PAIR] * (2 * leaves)
        for i in range(n - 1):
            rank = ranks.get(piece[i:i + 2])
            if rank is not None:
                tree[leaves + i] = rank * n + i
        for i in range(leaves - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        end, before = list(range(1, n + 1)), list(range(-1, n))
        while tree[1] != NO_PAIR:
            at = tree[1] % n
            taken = end[at]
            stop = end[at] = end[taken]
            before[stop] = at
            left = before[at]
            for i, upto in ((taken, None), (at, end[stop] if stop < n else None), (left, stop if left >= 0 else None)):
                if i < 0:
                    continue
                rank = None if upto is None else ranks.get(piece[i:upto])
                value = NO_PAIR if rank is None else rank * n + i
                node = leaves + i
                while tree[node] != value:
                    tree[node] = value
                    node //= 2
                    if not node:
                        break
                    a, b = tree[2 * node], tree[2 * node + 1]
                    value = a if a < b else b
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:end[i]]])
            i = end[i]
        return ids

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of distinct pieces in the flat arrays; new ones are merged."""
        known = self.number
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > REMEMBER or self.held > REMEMBER_BYTES:
            self.forget()
            known, new = self.number, pieces
        if new:
            merged = list(map(self.merge, new))
            size = np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.held += sum(map(len, new))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in merged for i in ids), dtype=np.int32, count=int(size.sum()))])
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of ids for every text."""
        pieces, borders = split_pieces(texts)
        if not len(pieces):
            return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array([], pa.int32()))
        coded = pieces.dictionary_encode()
        numbers = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, ends = gather(self.flat, self.start, self.size, numbers)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends])[borders], pa.int32()), pa.array(ids))

    def decode(self, lists: pa.Array) -> pa.Array:
        """The bytes of every list of ids."""
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known_id) or not self.known_id[ids].all()):
            raise ValueError("an id outside the rank file")
        borders = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        data, ends = gather(self.bytes_of, self.bytes_start, self.bytes_size, ids)
        cuts = np.concatenate([[0], ends])[borders].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])


@lru_cache(1)
def worker_model(path: str) -> RankModel:
    return RankModel(path)


def _ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with sizes of at most `most` together, or of one row."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def encode(docs: DataFrame, path: str, name: str = "ids") -> DataFrame:
    """docs with the ids of every whole text by the ranks of the file, each piece on its own, without special tokens.

    A null or empty text has no ids, repeated rows have the same ids, a text of any length is taken whole. A column named
    like the result is replaced, all others are kept; an empty table gives an empty table.
    """

    def run(batches, fields):
        model = worker_model(path)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _ranges(sizes, CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, model.encode(texts.slice(a, b - a))], [*fields, name])

    return through_tasks(docs, run, f"`{name}` array<int>")


def decode(rows: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """rows(ids, ...) with the bytes of their ids; null or no ids give no bytes. Ids outside the file fail the job."""

    def run(batches, fields):
        model = worker_model(path)
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _ranges(sizes, CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, model.decode(lists.slice(a, b - a))], [*fields, name])

    return through_tasks(rows, run, f"`{name}` binary")
