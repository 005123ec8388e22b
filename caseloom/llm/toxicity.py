"""Toxicity by class-conditional Kneser-Ney models over the characters of words: length-normalised likelihood of toxic against ordinary text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.session import cut_lineage

#: Characters of a gram; each takes 12 bits of a long, so a suffix is a mask and a context is a shift.
ORDER = 4
BITS = 12
DISCOUNT = 0.75
#: Nats by which toxic must outweigh ordinary before a word counts; below it, chance differences of long texts would add up.
WORD_EVIDENCE = 4.0
#: Slots of the tables every task holds, 4 bytes each; both are primes. Grams that share a slot share a mean weighted by count.
GRAM_SLOTS = 4_194_301
CONTEXT_SLOTS = 1_048_573
#: Bound of the sample on which the logistic curve from likelihood to score is fitted.
CALIBRATION_ROWS = 20_000
CHUNK = 1 << 20
PAD = " " * (ORDER - 1)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of all texts in one array, and where each text's grams begin (one more entry at the end).

    Texts are lower-cased with single blanks and begin and end in blanks, so a gram never mixes two texts' letters.
    """
    plain = [PAD + " ".join(t.lower().split()) + " " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) & ((1 << BITS) - 1)
    sizes = np.array([len(p) for p in plain], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    packed = codes[: len(codes) - ORDER + 1].copy()
    for k in range(1, ORDER):
        packed = (packed << BITS) | codes[k: len(codes) - ORDER + 1 + k]
    # windows that begin in a text and end in the next one
    own = np.ones(len(packed), dtype=bool)
    for k in range(1, ORDER):
        inner = starts[1:-1] - k
        own[inner[(inner >= 0) & (inner < len(own))]] = False
    begins = np.concatenate([[0], np.cumsum(np.maximum(sizes - ORDER + 1, 0))])
    return packed[own], begins


def _chunks(texts: list[str]):
    """Index ranges of texts of about CHUNK characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + ORDER
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _count(batches):
    """(gram, toxic count, ordinary count), added up inside each task."""
    total: list[tuple[np.ndarray, np.ndarray]] = []

    def folded(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        found, at = np.unique(keys, return_inverse=True)
        return found, np.stack([np.bincount(at, weights=counts[:, c], minlength=len(found)) for c in (0, 1)], axis=1)

    for batch in batches:
        texts, toxic = [t or "" for t in batch.column("text").to_pylist()], np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
        for a, b in _chunks(texts):
            grams, begins = grams_of(texts[a:b])
            flags = np.repeat(toxic[a:b], np.diff(begins))
            found, at = np.unique(grams, return_inverse=True)
            counts = np.stack([np.bincount(at, weights=flags, minlength=len(found)), np.bincount(at, weights=1 - flags, minlength=len(found))], axis=1)
            total.append((found, counts))
            if sum(len(k) for k, _ in total) > 4 * CHUNK:
                total = [folded(total)]
    if total:
        keys, counts = folded(total)
        for a in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + 50_000]), *(pa.array(counts[a:a + 50_000, c].astype(np.int64)) for c in (0, 1))], ["gram", "c1", "c0"])


def smoothed(counts: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """From gram counts per class: (gram, llr, n) of seen grams and (context, llr, n) for unseen grams after a context.

    p_class(x | context) = (max(c - D, 0) + D * kinds(context) * p(x | context)) / c(context), where p is the Kneser-Ney model
    of both classes together: the same formula on the summed counts, backing off to numbers of different left
    neighbours. So what is rare in one class leans on shared counts, and where neither class saw the gram, p is the same
    in both and the ratio is that of the two backoff weights.
    """
    mask = lambda n: (1 << (BITS * n)) - 1
    context = lambda c: F.shiftright(c, BITS)
    lower = counts.select(F.col("gram").bitwiseAND(F.lit(mask(ORDER - 1))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    levels = {ORDER - 1: lower}
    for n in range(ORDER - 2, 0, -1):
        levels[n] = levels[n + 1].select(F.col("g").bitwiseAND(F.lit(mask(n))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # order 1: share of left neighbours
    whole = levels[1].agg(F.sum("n").alias("all"))
    shared = levels[1].join(F.broadcast(whole)).select("g", (F.col("n") / F.col("all")).alias("q"))
    for n in range(2, ORDER):
        level = levels[n].withColumn("h", context(F.col("g"))).withColumn("s", F.col("g").bitwiseAND(F.lit(mask(n - 1))))
        sums = level.groupBy("h").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        shared = (
            level.join(sums, "h").join(shared.withColumnRenamed("g", "s"), "s")
            .select("g", ((F.col("n") - discount + discount * F.col("kinds") * F.col("q")) / F.col("all")).alias("q"))
        )
    rows = counts.withColumn("h", context(F.col("gram"))).withColumn("g", F.col("gram").bitwiseAND(F.lit(mask(ORDER - 1))))
    contexts = rows.groupBy("h").agg(*[f for c in ("c1", "c0") for f in (F.sum(c).alias(f"{c}_all"), F.sum((F.col(c) > 0).cast("int")).alias(f"{c}_kinds"))], F.count(F.lit(1)).alias("all_kinds"))
    for c in ("c1", "c0"):
        contexts = contexts.withColumn(f"{c}_off", F.when(F.col(f"{c}_all") > 0, discount * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(1.0))
    both, kinds = F.col("c1") + F.col("c0"), F.col("all_kinds")
    p = lambda c: F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - discount, F.lit(0)) / F.col(f"{c}_all")).otherwise(0.0) + F.col(f"{c}_off") * F.col("pooled")
    pooled = (both - discount + discount * kinds * F.col("q")) / (F.col("c1_all") + F.col("c0_all"))
    seen = rows.join(contexts, "h").join(shared, "g").withColumn("pooled", pooled).select("gram", F.log(p("c1") / p("c0")).alias("llr"), both.alias("n"))
    unseen = contexts.select(F.col("h").alias("gram"), F.log(F.col("c1_off") / F.col("c0_off")).alias("llr"), (F.col("c1_all") + F.col("c0_all")).alias("n"))
    return seen, unseen


def slotted(rows: DataFrame, slots: int) -> np.ndarray:
    """Ratios by gram modulo the number of slots; NaN where nothing was seen. At most one row per slot reaches the driver."""
    table = np.full(slots, np.nan, dtype=np.float32)
    got = rows.groupBy(F.pmod(F.col("gram"), F.lit(slots)).alias("slot")).agg((F.sum(F.col("llr") * F.col("n")) / F.sum("n")).cast("float").alias("llr")).toArrow()
    table[got.column("slot").to_numpy()] = got.column("llr").to_numpy()
    return table


@dataclass
class Model:
    grams: np.ndarray
    contexts: np.ndarray
    slope: float = 0.0
    offset: float = -30.0

    def ratios(self, texts: list[str]) -> np.ndarray:
        """Evidence of each text: its words' log-likelihood ratios above WORD_EVIDENCE, summed, over the root of its number of words."""
        out = np.zeros(len(texts))
        for a, b in _chunks(texts):
            grams, begins = grams_of(texts[a:b])
            value = self.grams[grams % GRAM_SLOTS]
            miss = np.flatnonzero(np.isnan(value))
            value[miss] = self.contexts[(grams[miss] >> BITS) % CONTEXT_SLOTS]
            # every text ends in a blank, so words lie between grams that end in one
            ends = np.flatnonzero((grams & ((1 << BITS) - 1)) == 32)
            word = np.diff(np.cumsum(np.nan_to_num(value, copy=False), dtype=np.float64)[ends], prepend=0.0)
            owner = np.searchsorted(begins, ends, side="right") - 1
            n = b - a
            found = np.bincount(owner, weights=np.maximum(word - WORD_EVIDENCE, 0), minlength=n)
            out[a:b] = np.log1p(found / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1)))
        return out


def ratio_rows(docs: DataFrame, model: Model) -> DataFrame:
    """docs with column ratio, from whole texts; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            values = shared.value.ratios([t or "" for t in batch.column("text").to_pylist()])
            rest = batch.select(names)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(values)], [*names, "ratio"])

    names = [c for c in docs.columns if c != "text"]
    return docs.mapInArrow(score, docs.drop("text").withColumn("ratio", F.lit(0.0)).schema)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge."""
    scale = max(float(np.abs(x).max(initial=0.0)), 1e-9)
    design, w = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hess, design.T @ (y - p) - 1e-3 * w)
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Model | None:
    """Counts over all labelled texts that `train` admits.

    The curve is fitted on a fifth by another hash, scored by counts over the rest; then that fifth is counted too.
    Of several labels of a document the largest holds; null labels and ids teach nothing. None when a class is missing.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).filter(train)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    # one way of joining at every size: labels grow with the documents
    labelled = marked.hint("merge")
    rows = docs.select("doc_id", "text").join(labelled, "doc_id")
    added = lambda c: c.groupBy("gram").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    counted = lambda part: cut_lineage(added(part.select("text", "toxic").mapInArrow(_count, "gram long, c1 long, c0 long")))
    most, fifth = counted(rows.filter(~held)), counted(rows.filter(held))
    both_classes = lambda c: all(c.agg(F.sum("c1"), F.sum("c0")).first())
    counts = cut_lineage(added(most.unionByName(fifth)))
    if not both_classes(counts):
        return None
    tables = lambda c: [slotted(part, slots) for part, slots in zip(smoothed(c), (GRAM_SLOTS, CONTEXT_SLOTS))]
    whole = Model(*tables(counts), 10.0, -1.0)
    if not both_classes(most):  # too few rows for a curve
        return whole
    model = Model(*tables(most))
    # the texts the curve is fitted on, chosen by hash
    picked = marked.filter(held).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(CALIBRATION_ROWS)
    sample = ratio_rows(docs.select("doc_id", "text").join(picked.hint("merge"), "doc_id").select("text", "toxic"), model).select("ratio", "toxic").toArrow()
    y = sample.column("toxic").to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        whole.slope, whole.offset = logistic(sample.column("ratio").to_numpy(), y)
    return whole


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row; without a model every score is 0."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    rows = ratio_rows(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (1 / (1 + F.exp(-(F.lit(model.slope) * F.col("ratio") + F.lit(model.offset))))).alias("score"), "ratio")
