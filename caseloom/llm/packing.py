"""Token sequences of a fixed length: first-fit decreasing with a tournament tree, in random groups of documents."""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.units import UnitMemory
from caseloom.llm.words import WORD
from caseloom.session import cut_lineage

LENGTH = 4096
END_ID = 2
#: Tokens of one random group; its lengths are packed in one task, about 100 000 rows of a few numbers at most for long-run averages.
GROUP_TOKENS = 512 * LENGTH
SPECIAL = "<|endoftext|>"
AT_ONCE = 256
# one run of Latin letters is one unit of the tokenizer and so ends in exactly one word-end token
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# the units of a lower-case Latin-1 text without apostrophes: runs of letters, and runs of other marks between blanks
UNITS = re.compile("[a-zªµºß-öø-ÿ]+|[^a-zªµºß-öø-ÿ\t\n\x0b\x0c\r \x85\xa0]+")
# what str.split() takes for blanks and the tokenizer does not
NOT_BLANK = re.compile("[\x1c-\x1f]")


class WordEncoder(UnitMemory):
    """Ids by a tokenizer whose tokens never cross blanks, for texts put together from distinct units."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SPECIAL)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encoded(self, words: list[str], glue: str) -> list[np.ndarray]:
        joined = [glue.join(words[k:k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)]
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]

    def learn(self, units: list[str]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
        """Plain units are encoded together between blanks, others between special tokens or alone."""
        plain = [u for u in units if PLAIN.fullmatch(u)]
        parted = [u for u in units if not PLAIN.fullmatch(u) and "<|" not in u]
        odd = [u for u in units if "<|" in u]
        chunks, sizes = [], []
        for ids in self._encoded(plain, " "):
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            chunks.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        for ids in self._encoded(parted, SPECIAL):
            cuts = np.flatnonzero(ids == self.separator)
            chunks.append(np.delete(ids, cuts))
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        for u in odd:
            own = np.array(self.tokenizer.encode(u, add_special_tokens=False).ids, dtype=np.uint32)
            chunks.append(own)
            sizes.append(np.array([len(own)]))
        return plain + parted + odd, chunks, np.concatenate(sizes).astype(np.int64)

    @staticmethod
    def parts(text: str) -> list[str]:
        """Pieces of a text that the tokenizer encodes on their own, as few different ones as is safe.

        In Latin-1 its lower case and its letters are those of Python, so such texts part at every border of letters;
        others, and texts with contractions, part at blanks only.
        """
        try:
            plain = "<|" not in text and (text.isascii() or bool(text.encode("latin-1")))
        except UnicodeEncodeError:
            plain = False
        if plain:
            text = text.lower()
            if "'" not in text:
                return UNITS.findall(text)
        return WORD.findall(text) if NOT_BLANK.search(text) else text.split()


@lru_cache(1)
def worker_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `length` ids of every text followed by end_id: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches):
        encoder = worker_encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(texts), 256):
                rows = []
                for doc, own in zip(ids[at:at + 256], encoder.encode(texts[at:at + 256])):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), length):
                        part = own[s:s + length]
                        rows.append((doc, s, len(part), zlib.crc32(part.tobytes()), len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(lengths, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, in the given order, each into the first bin with room.

    The tree's leaves hold the room left in each bin and every inner node the larger of its two, so the first bin
    that fits is found by going down, left where there is room.
    """
    lengths = [int(x) for x in lengths]
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for k, need in enumerate(lengths):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left >= right else right
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces with sequence_id and offset. Groups are drawn by a hash of id, start and row position, so repeated rows and sources are spread.

    Repeated rows are packed each on its own; an empty input gives no rows.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))

    def fill(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit(frame["length"], length)
        frame["sequence_id"] = bins + (int(key[0]) << 32)
        frame["offset"] = offsets
        return frame[names]

    names = [*pieces.columns, "sequence_id", "offset"]
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"{n} long" for n in names)
    return grouped.groupBy("_group").applyInPandas(fill, schema)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every id of every text in exactly one piece, packed. Null and empty texts are the end id alone."""
    return pack(cut_lineage(token_pieces(docs, path, length, end_id)), length)
