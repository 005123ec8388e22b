"""Approximate nearest vectors: inverted lists of product-quantised residuals, and an exact look at a shortlist.

A bounded sample of unit vectors gives the centres of the lists and, per sub-space, the code words of what is left after the
nearest centre is taken away. Every vector is stored, as its list and one byte per sub-space. A query scans the lists of its
nearest centres with look-up tables, and the vectors of its shortlist decide the order and the scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.vectors import stack, unit_rows
from caseloom.session import cut_lineage, top_per_key

#: Vectors that the centres and code words are trained on, at most; the index holds all vectors.
SAMPLE = 20_000
#: Sampled vectors per list and per code word, at least; numbers of a sub-space; code words of one byte.
PER_LIST, PER_WORD, SUB_SPACE, WORDS = 16, 4, 4, 256
ROUNDS = 12
#: A query looks into as many lists as hold this share of the nearest TUNING_K neighbours of TUNING_ROWS sampled vectors.
TARGET, TUNING_ROWS, TUNING_K = 0.97, 256, 10
#: Candidates per wanted hit that are compared exactly.
SHORTLIST = 20
#: Stored vectors and queries that meet in one task, numbers held there at a time, and rows whose way to all centres is held.
PART_ROWS, BLOCK_QUERIES, CELLS, NEAR_ROWS = 100_000, 2048, 1 << 21, 1024


def k_means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of rows by Lloyd's rounds; a centre without rows takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(rows))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own, far = nearest(rows, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = rows[np.argsort(-far)[:len(empty)]]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row and the squared distance to it; the distances to all centres are held for NEAR_ROWS rows."""
    own, far, squares = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows)), (centres ** 2).sum(axis=1)
    for a in range(0, len(rows), NEAR_ROWS):
        part = rows[a:a + NEAR_ROWS]
        away = squares - 2 * part @ centres.T
        own[a:a + NEAR_ROWS] = best = away.argmin(axis=1)
        far[a:a + NEAR_ROWS] = away[np.arange(len(part)), best] + (part ** 2).sum(axis=1)
    return own, far


def lists_needed(rows: np.ndarray, centres: np.ndarray, target: float = TARGET) -> int:
    """How many of its nearest lists a vector must look into to meet `target` of its nearest neighbours among rows."""
    asked = rows[:: max(1, len(rows) // TUNING_ROWS)][:TUNING_ROWS]
    like = asked @ rows.T
    like[like > 1 - 1e-9] = -np.inf  # itself and its copies, which lie in its own list
    k = min(TUNING_K, len(rows))
    near = np.argpartition(-like, k - 1, axis=1)[:, :k]
    away = (centres ** 2).sum(axis=1) - 2 * asked @ centres.T
    place = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
    own, _ = nearest(rows, centres)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))])


@dataclass(frozen=True)
class Quantiser:
    """centres[list, dimension] and words[sub-space, word, dimension of the sub-space]; dimensions are filled up with zeros.

    probes is the number of lists that the sample shows to be needed.
    """

    centres: np.ndarray
    words: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def units(self, column) -> np.ndarray:
        rows = unit_rows(stack(column))
        if not self.width:  # an empty index has no dimensions
            return np.zeros((len(rows), 0))
        return np.pad(rows, ((0, 0), (0, self.width - rows.shape[1])))

    def probed(self, rows: np.ndarray, probes: int) -> np.ndarray:
        """base[row, list]: the part of an estimate that the list's centre gives, -inf for all but the nearest lists."""
        base = rows @ self.centres.T
        if probes < len(self.centres):
            away = (self.centres ** 2).sum(axis=1) - 2 * base
            np.put_along_axis(base, np.argsort(away, axis=1, kind="stable")[:, probes:], -np.inf, axis=1)
        return base

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists, _ = nearest(rows, self.centres)
        left = rows - self.centres[lists]
        step = self.words.shape[2]
        codes = [nearest(left[:, s * step:(s + 1) * step], words)[0] for s, words in enumerate(self.words)]
        return lists, np.stack(codes, axis=1).astype(np.uint8)


@dataclass(frozen=True)
class VectorIndex:
    quantiser: Quantiser
    #: case_id, item_id, list, code
    codes: DataFrame
    #: case_id, item_id, vector
    vectors: DataFrame


def train(vectors: DataFrame, sample: int = SAMPLE, lists: int | None = None, seed: int = 7) -> Quantiser:
    """Centres and code words from at most `sample` vectors, chosen by a hash of their ids.

    As many lists as the root of the number of vectors says, and as the sample can fill; the sub-spaces are trained in tasks
    of their own. The model that comes back is a few numbers per list and word.
    """
    total = vectors.count()
    chosen = cut_lineage(vectors.orderBy(F.xxhash64("case_id", "item_id"), "item_id").limit(sample).select("vector", F.lit(0).alias("all")))
    size = min(sample, total)
    lists = lists or max(1, min(math.isqrt(max(total, 1)), size // PER_LIST))
    words = max(1, min(WORDS, size // PER_WORD))

    def centres_of(frame: pd.DataFrame) -> pd.DataFrame:
        rows = unit_rows(stack(frame["vector"]))
        centres = k_means(rows, lists, seed)
        return pd.DataFrame({"centre": list(centres), "probes": lists_needed(rows, centres)})

    found = chosen.groupBy("all").applyInPandas(centres_of, "centre array<double>, probes int").collect()
    if not found:
        return Quantiser(np.zeros((1, 0)), np.zeros((0, 1, SUB_SPACE)), 1)
    centres = np.array([r.centre for r in found])
    spaces = -(-centres.shape[1] // SUB_SPACE)
    padded = np.pad(centres, ((0, 0), (0, spaces * SUB_SPACE - centres.shape[1])))

    def words_of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = unit_rows(stack(frame["vector"]))
        rows = np.pad(rows, ((0, 0), (0, padded.shape[1] - rows.shape[1])))
        left = rows - padded[nearest(rows, padded)[0]]
        return pd.DataFrame({"space": int(key[0]), "word": list(k_means(left[:, key[0] * SUB_SPACE:(key[0] + 1) * SUB_SPACE], words, seed))})

    copied = chosen.select("vector", F.explode(F.sequence(F.lit(0), F.lit(spaces - 1))).alias("space"))
    rows = copied.groupBy("space").applyInPandas(words_of, "space int, word array<double>").collect()
    return Quantiser(padded, np.stack([np.array([r.word for r in rows if r.space == s]) for s in range(spaces)]), found[0].probes)


def build(vectors: DataFrame, quantiser: Quantiser | None = None) -> VectorIndex:
    """The index of all vectors(case_id, item_id, vector); each is read once and written as its list and code."""
    quantiser = quantiser or train(vectors)

    def encoded(frames):
        for frame in frames:
            lists, codes = quantiser.encode(quantiser.units(frame["vector"])) if len(frame) else (np.zeros(0, int), [])
            yield pd.DataFrame({"case_id": frame["case_id"], "item_id": frame["item_id"], "list": lists, "code": [c.tobytes() for c in codes]})

    named = vectors.select("case_id", F.col("item_id").cast("string"), "vector")
    codes = named.mapInPandas(encoded, "case_id string, item_id string, list int, code binary")
    return VectorIndex(quantiser, cut_lineage(codes), named)


def _part(key: str, n: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(n)).cast("int")


def _copies(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def shortlists(index: VectorIndex, queries: DataFrame, size: int, probes: int | None = None) -> DataFrame:
    """query_id, case_id, item_id: the `size` items of the probed lists with the best estimates.

    A case's lists are dealt into groups of about PART_ROWS vectors, a larger group is cut into parts. A query goes once to
    each part of a group in which it probes a list, however many it probes there; the lists are found again in the task.
    """
    quantiser = index.quantiser
    probes = probes or quantiser.probes
    share = lambda n: F.ceil(F.count(F.lit(1)) / F.lit(n)).cast("int")
    groups = index.codes.groupBy("case_id").agg(share(PART_ROWS).alias("groups"))
    dealt = index.codes.join(groups, "case_id").withColumn("group", F.col("list") % F.col("groups")).drop("groups")

    def probed(frames):
        for frame in frames:
            for a in range(0, len(frame), NEAR_ROWS):
                part = frame.iloc[a:a + NEAR_ROWS]
                met = np.isfinite(quantiser.probed(quantiser.units(part["vector"]), probes))
                yield pd.DataFrame({"query_id": part["query_id"], "case_id": part["case_id"], "vector": part["vector"],
                                    "group": [np.unique(np.flatnonzero(m) % n) for m, n in zip(met, part["groups"])]})

    asked = queries.select(F.col("query_id").cast("string"), "case_id", F.col("vector").cast("array<double>")).join(groups, "case_id")
    asked = cut_lineage(asked.mapInPandas(probed, "query_id string, case_id string, vector array<double>, group array<int>").withColumn("group", F.explode("group")))
    where = ["case_id", "group"]
    sizes = asked.groupBy(*where).agg(share(BLOCK_QUERIES).alias("blocks")).join(dealt.groupBy(*where).agg(share(PART_ROWS).alias("parts")), where)
    left = asked.join(sizes, where).withColumn("block", _part("query_id", "blocks")).withColumn("part", _copies("parts")).drop("blocks", "parts")
    right = dealt.join(sizes, where).withColumn("part", _part("item_id", "parts")).withColumn("block", _copies("blocks")).drop("blocks", "parts")

    def scan(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            codes = np.frombuffer(b"".join(v["code"]), dtype=np.uint8).reshape(len(v), -1)
            items, lists = v["item_id"].to_numpy(object), v["list"].to_numpy()
            units = quantiser.units(q["vector"])
            base = quantiser.probed(units, probes)
            near = np.argsort(base.argmax(axis=1), kind="stable")  # queries of the same lists are scanned together
            step = max(1, CELLS // len(v))
            for a in range(0, len(q), step):
                own = near[a:a + step]
                tables = np.einsum("swd,qsd->qsw", quantiser.words, units[own].reshape(len(own), codes.shape[1], -1))
                rows = np.flatnonzero(np.isfinite(base[own]).any(axis=0)[lists])
                if not len(rows):
                    continue
                guess = base[own][:, lists[rows]]
                for s in range(codes.shape[1]):
                    guess += tables[:, s][:, codes[rows, s]]
                keep = np.argpartition(-guess, size - 1, axis=1)[:, :size] if len(rows) > size else np.tile(np.arange(len(rows)), (len(own), 1))
                best = np.take_along_axis(guess, keep, axis=1)
                who, place = np.nonzero(np.isfinite(best))
                out.append(pd.DataFrame({
                    "query_id": q["query_id"].to_numpy(object)[own[who]], "case_id": q["case_id"].iloc[0],
                    "item_id": items[rows[keep[who, place]]], "guess": best[who, place]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "case_id": [], "item_id": [], "guess": []})

    keys = [*where, "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id string, case_id string, item_id string, guess double")
    return top_per_key(found, ["query_id", "case_id"], [F.col("guess").desc(), F.col("item_id")], size).select("query_id", "case_id", "item_id")


def _cosine(one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series(np.round(np.einsum("ij,ij->i", unit_rows(stack(one)), unit_rows(stack(other))), 9))


def approximate_topk(index: VectorIndex, queries: DataFrame, k: int, threshold: float, probes: int | None = None, shortlist: int = SHORTLIST) -> DataFrame:
    """As retrieve.vector_topk() over the shortlist: query_id, case_id, item_id, score, rank. Scores are exact; a hit outside it is missed."""
    narrow = shortlists(index, queries, k * shortlist, probes)
    asked = queries.select(F.col("query_id").cast("string"), "case_id", F.col("vector").alias("_asked"))
    full = narrow.join(index.vectors, ["case_id", "item_id"]).join(asked, ["query_id", "case_id"])
    cosine = F.pandas_udf(_cosine, "double")
    scored = full.select("query_id", "case_id", "item_id", cosine("_asked", "vector").alias("score")).filter(F.col("score") >= threshold)
    return top_per_key(scored, ["query_id", "case_id"], [F.col("score").desc(), F.col("item_id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """hits, wanted: how many of the exact (query_id, case_id, item_id) were found."""
    key = ["query_id", "case_id", "item_id"]
    marked = exact.select(*key).join(found.select(*key, F.lit(1).alias("hit")), key, "left")
    return marked.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("wanted"))
