"""Language of a text by string kernels: n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.frames import carry, restore, through_tasks
from caseloom.session import top_per_key

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
#: Bounds of the fit: labelled rows over all languages (8 KB of presence bits each on the driver), and landmarks among them.
TRAIN_ROWS = 2048
LANDMARKS = 192
RIDGE = 1e-4
BLOCK = 64
#: Below this share of the positive class scores a text counts as no language at all.
MIN_SCORE = 0.2
#: Least lead of the winner's raw score (about 1 where its language is sure, -1 where another's is) over the second one's.
#: The share above cannot be low with few languages; in an unknown one all raw scores are alike.
MIN_MARGIN = 0.25
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
# ASCII other than letters carries no language and becomes a blank
_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def gram_buckets(text: str) -> np.ndarray:
    """Hash buckets of all character n-grams of the lower-cased text, blanks at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes)
    found, rolled = [], codes * np.uint32(0x01000193)
    for n in range(2, ORDERS[-1] + 1):
        rolled = (rolled[:-1] ^ codes[n - 1:]) * np.uint32(0x01000193)
        if n in ORDERS:
            found.append((rolled * np.uint32(0x9E3779B1) + np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)) >> np.uint32(16))
    return np.concatenate(found)


def presence(texts: list[str]) -> np.ndarray:
    """A row per text, 1 where a bucket occurs: the explicit feature vector of the blended-spectrum presence kernel."""
    rows = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for row, text in zip(rows, texts):
        row[gram_buckets(text)] = 1
    return rows


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: landmark rows times their dual weights

    def scores(self, texts: list[str]) -> np.ndarray:
        rows = presence(texts)
        return (rows @ self.weights) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def _presence_bits(batches):
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang")
        for at in range(0, len(texts), BLOCK):
            bits = [np.packbits(r.astype(bool)).tobytes() for r in presence(texts[at:at + BLOCK])]
            yield pa.RecordBatch.from_arrays([langs.slice(at, BLOCK), pa.array(bits, pa.binary())], ["lang", "bits"])


def training_rows(docs: DataFrame, train: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most `rows` labelled texts with a letter, the same number per language, chosen by a hash of the id; columns lang, text."""
    labelled = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    names = labelled.select("lang").distinct().count()
    per = max(1, rows // max(1, names))
    ids = top_per_key(labelled.select("doc_id", "lang").dropDuplicates(), ["lang"], [F.xxhash64("doc_id"), "doc_id"], per).select("doc_id").distinct()
    wanted = [r.doc_id for r in ids.limit(rows).collect()]
    return labelled.filter(F.col("doc_id").isin(wanted)).filter(F.col("text").rlike(r"\p{L}")).groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, train: Column, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Kernel ridge regression on landmark kernels; None when there is no labelled text.

    Presence bits come back from the tasks, at most rows x 8 KB; the normal equations are landmarks x landmarks.
    """
    got = training_rows(docs, train, rows).mapInArrow(_presence_bits, "lang string, bits binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, bytes(r.bits)))
    languages = sorted({r.lang for r in got})
    picks = {name: [r for r in got if r.lang == name] for name in languages}
    share = max(1, landmarks // len(languages))
    chosen = [r for name in languages for r in picks[name][::max(1, len(picks[name]) // share)][:share]]
    unpack = lambda part: unit(np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in part]).astype(np.float32))
    land = unpack(chosen)
    kernel = np.concatenate([unpack(got[at:at + 128]) @ land.T for at in range(0, len(got), 128)]).astype(np.float64)
    target = np.array([[1.0 if r.lang == name else -1.0 for name in languages] for r in got])
    # every language weighs the same, whatever its number of rows
    weight = np.array([1.0 / len(picks[r.lang]) for r in got])[:, None]
    among = (land @ land.T).astype(np.float64)
    left = kernel.T @ (weight * kernel) + RIDGE * len(languages) * among + 1e-8 * np.eye(len(chosen))
    dual = np.linalg.solve(left, kernel.T @ (weight * target))
    return Model(languages, (land.T @ dual).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, keep_text: bool = False) -> DataFrame:
    """lang_pred, score and margin beside the columns of docs (text only on demand), one row per input row, from whole texts.

    score is the winner's share of the positive parts, margin its raw score's lead over the second (over 0 where a single
    language was learned). A null text or one without a letter is `und` with score and margin 0; so is every text when
    nothing could be learned. Columns of docs named like the results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches, fields):
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores, margins = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t and m and LETTER.search(t)]
            for k in range(0, len(at), BLOCK):
                part = at[k:k + BLOCK]
                raw = m.scores([texts[i] for i in part])
                ranked = np.sort(raw, axis=1)
                margins[part] = ranked[:, -1] - (ranked[:, -2] if len(m.languages) > 1 else 0)
                positive = np.maximum((raw + 1) / 2, 0)
                best = positive.argmax(axis=1)
                top = positive.max(axis=1) / np.maximum(positive.sum(axis=1), 1e-9)
                for i, b, s in zip(part, best, top):
                    names[i], scores[i] = m.languages[b], s
            kept = batch.select(fields)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], [*fields, "lang_pred", "score", "margin"])

    return through_tasks(docs, label, "lang_pred string, score double, margin double", () if keep_text else ("text",))


def language_stage(docs: DataFrame, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Documents with a recognised language, columns as they are; the labels of docs itself teach the model."""
    kept = predict(carry(docs), fit(docs, F.lit(True)), keep_text=True)
    return restore(kept.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & (F.col("margin") >= min_margin)), docs)
