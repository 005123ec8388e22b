"""Encoding and decoding with the pieces of a SentencePiece model: forward search over a trie of distinct marked words."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.frames import through_tasks
from caseloom.llm.units import UnitMemory

MARK = "▁"
#: Pairs of pieces whose merging is remembered, and words per worker whose ids are.
PAIRS, REMEMBER = 400_000, 400_000
BATCH = 1000
LAST = float("inf")
LETTER = r"[^\W_]"


class PieceModel(UnitMemory):
    """Pieces and scores of a model file of type BPE with byte fallback, dummy prefix and blanks kept.

    The last piece of a prefix's encoding is the one piece that ends there and stays apart from the piece before it,
    when the two alone are merged in order of score. So a forward pass needs the last piece of every shorter prefix
    only, and words with a common prefix share that part of the pass. The result is the model's own encoding.
    """

    remember = REMEMBER

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.plain = np.array([i not in self.byte_of and i not in self.silent for i in range(n)])
        usable = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.number_of = {self.pieces[i]: i for i in usable}
        self.rank = {self.pieces[i]: -model.get_score(i) for i in usable}
        # by the last characters of a prefix, up to three, the lengths of the pieces that may end there, longest first
        lengths: dict[str, set[int]] = {}
        for p in self.rank:
            for n in range(1, min(3, len(p)) + 1):
                lengths.setdefault(p[-n:], set()).add(len(p))
        self.lengths = {}
        for tail, own in lengths.items():
            if len(tail) == 3:
                own = own | {n for n in (1, 2) if n in lengths.get(tail[-n:], ())}
            self.lengths[tail] = tuple(sorted(own | {1}, reverse=True))
        if len(self.byte_id) != 256 or any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("the model needs byte fallback and pieces with marks at their start only")
        # characters that no piece holds together with another one part words wherever they stand
        lone = "".join(c for c in map(chr, range(128)) if not c.isalnum() and not any(c in p and len(p.strip(c)) for p in self.rank))
        # where no piece has one of the signs right after a letter or digit, words part there
        signs = {c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in lone}
        signs -= {y for p in self.rank for x, y in zip(p, p[1:]) if re.match(LETTER, x)}
        none, sign = MARK + re.escape(lone), "".join(map(re.escape, sorted(signs)))
        more = f"[^{none}{sign}]+|(?<!{LETTER})[{sign}]" if sign else f"[^{none}]+"
        self.units = re.compile(f"{MARK}*[^{none}](?:{more})*|{MARK}+" + (f"|[{re.escape(lone)}]+" if lone else ""))
        self.apart: dict[tuple[str, str], bool] = {}
        self.spines: dict[str, tuple[list, list]] = {}

    def merged(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """Merge neighbours, best score first and leftmost of equals, until no two make a piece; and how each piece came about."""
        parts, made = list(text), {}
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return parts, made
            i = best[1]
            made[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def spine(self, piece: str) -> tuple[list, list] | None:
        """What stands at the piece's left and at its right end while it is merged, each with its rank; None if it is never made."""
        if piece not in self.spines:
            parts, made = self.merged(piece)
            ends = []
            for side in (0, 1):
                at, line = piece, []
                while at in made:
                    line.append((at, self.rank[at]))
                    at = made[at][side]
                ends.append([(at, 0.0), *reversed(line)])
            self.spines[piece] = (ends[0], ends[1]) if len(parts) == 1 else None
        return self.spines[piece]

    def stays(self, before: str, piece: str) -> bool:
        """Whether two neighbouring pieces come about and no merge crosses their border."""
        found = self.apart.get((before, piece))
        if found is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            found = self.apart[before, piece] = self._stays(before, piece)
        return found

    def _stays(self, before: str, piece: str) -> bool:
        if not before:
            return self.spine(piece) is not None
        if self.spine(before) is None or self.spine(piece) is None:
            return False
        left, right = self.spine(before)[1], self.spine(piece)[0]
        i = j = 0
        while True:
            cross = self.rank.get(left[i][0] + right[j][0], LAST)
            grow_left = left[i + 1][1] if i + 1 < len(left) else LAST
            grow_right = right[j + 1][1] if j + 1 < len(right) else LAST
            if cross < grow_left and cross <= grow_right and cross < LAST:
                return False
            if grow_left == grow_right == LAST:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def ids_of(self, piece: str) -> list[int]:
        found = self.number_of.get(piece)
        return [found] if found is not None else [self.byte_id[b] for b in piece.encode("utf-8")]

    def parts(self, text: str) -> list[str]:
        return self.units.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, units: list[str]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
        """Ids of distinct words in trie order: the states of the prefix shared with the word before are kept."""
        ids: list[int] = []
        sizes: list[int] = []
        last: list[str] = [""]  # last piece of every prefix of the current word
        before = ""
        known, apart, lengths, alone = self.rank, self.apart, self.lengths, (1,)
        words = sorted(units)
        for word in words:
            common = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                common += 1
            del last[common + 1:]
            for end in range(common + 1, len(word) + 1):
                tail = word[max(0, end - 3):end]
                found = lengths.get(tail)
                if found is None:  # no piece of three characters or more ends here
                    found = (2, 1) if word[max(0, end - 2):end] in known else alone
                for n in found:
                    if n > end:
                        continue
                    start = end - n
                    piece = word[start:end]
                    if n == 1 or piece in known:
                        stays = apart.get((last[start], piece))
                        if self.stays(last[start], piece) if stays is None else stays:
                            last.append(piece)
                            break
                else:
                    raise ValueError("no piece ends here")
            at, own = len(word), []
            while at:
                own.append(last[at])
                at -= len(last[at])
            n = len(ids)
            for piece in reversed(own):
                found = self.number_of.get(piece)
                if found is None:
                    ids += self.ids_of(piece)
                else:
                    ids.append(found)
            sizes.append(len(ids) - n)
            before = word
        return words, [np.array(ids, dtype=np.uint32)], np.array(sizes, dtype=np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces are silent, byte runs are UTF-8 with broken bytes replaced, the first blank is the dummy prefix."""
        ids = np.asarray(ids, dtype=np.int64)
        if self.plain[ids].all():
            out = map(self.pieces.__getitem__, ids.tolist())
        else:
            out, run = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                if i not in self.silent:
                    out.append(self.pieces[i])
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ").removeprefix(" ")


@lru_cache(1)
def worker_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str, name: str = "ids") -> DataFrame:
    """docs with the ids of every whole text; a null or empty text has none. A column of the same name is replaced."""
    def run(batches, fields):
        model = worker_model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a in range(0, len(texts), BATCH):
                part = batch.slice(a, BATCH)
                found = model.encode(texts[a:a + BATCH])
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*fields, name])

    return through_tasks(docs, run, f"`{name}` array<int>")


def decode(rows: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """rows(ids, ...) with the text of their ids; null ids give an empty text. Ids outside the model fail the job."""

    def run(batches, fields):
        model = worker_model(path)
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            texts = [model.decode(flat[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(int), ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*fields, name])

    return through_tasks(rows, run, f"`{name}` string")
