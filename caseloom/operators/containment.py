"""Which texts contain which spans, without comparing every text with every span."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Characters of a gram, grams of a window; a span of at least LONG characters holds a whole window.
GRAM, WINDOW = 8, 9
LONG = GRAM + WINDOW - 1
#: Characters of the gram that stands for a shorter span.
SHORT = 4


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n characters; runs of different lengths differ."""
    out = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ codes[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _window_minima(codes: np.ndarray) -> np.ndarray:
    grams = _grams(codes, GRAM)
    return np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1)


def text_anchors(text: str, kinds: list[int]) -> list[int]:
    """What a contained span's anchor can be: the least gram of every window, and the short grams of the asked lengths."""
    codes, found = _codes(text), []
    for n in kinds:
        if len(codes) >= n:
            found.append(np.unique(_window_minima(codes) if n == LONG else _grams(codes, n)))
    return np.concatenate(found).view(np.int64).tolist() if found else []


def span_kind(length: int) -> int:
    return LONG if length >= LONG else min(SHORT, length)


def span_anchor(span: str) -> int:
    """The least gram of a long span's first window, or the least short gram: every text with the span has it too."""
    codes, n = _codes(span), span_kind(len(span))
    grams = _window_minima(codes[:LONG]) if n == LONG else _grams(codes, n)
    return int(grams.min().view(np.int64))


def containing_pairs(texts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text_id, span_id) of every span that occurs in a text of the same keys, exactly.

    texts(keys, text_id, text) and spans(keys, span_id, span). Texts and spans meet on one anchor per span, the least
    hash of a window of characters, so an anchor is as rare as the rarest part of the window and no text is
    listed by prefix or by common words. Candidates are narrow rows; the texts join later and decide by comparison.
    """
    filled = spans.filter(F.col("span") != "").select(*keys, "span_id", "span")
    size = F.length("span")
    kind = F.when(size >= LONG, LONG).otherwise(F.least(size, F.lit(SHORT)))
    kinds = sorted(r[0] for r in filled.select(kind).distinct().collect())  # at most five values

    @F.pandas_udf("array<bigint>")
    def of_text(column: pd.Series) -> pd.Series:
        return column.map(lambda t: text_anchors(t or "", kinds))

    @F.pandas_udf("bigint")
    def of_span(column: pd.Series) -> pd.Series:
        return column.map(span_anchor)

    listed = texts.select(*keys, "text_id", F.explode(of_text("text")).alias("anchor"))
    asked = filled.select(*keys, "span_id", of_span("span").alias("anchor"))
    candidates = listed.join(asked, [*keys, "anchor"]).select(*keys, "text_id", "span_id")
    checked = candidates.join(filled, [*keys, "span_id"]).join(texts.select(*keys, "text_id", "text"), [*keys, "text_id"])
    return checked.filter(F.contains("text", "span")).select(*keys, "text_id", "span_id").distinct()
