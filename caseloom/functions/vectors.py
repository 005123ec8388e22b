"""Numpy kernels for cosine search inside Spark tasks."""

from __future__ import annotations

import numpy as np

QUERY_BLOCK = 256


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero and so score zero."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))


class TopK:
    """Best k (score, id) per query over any number of blocks; ties go to the smaller id."""

    def __init__(self, n_queries: int, k: int, threshold: float):
        self.k, self.threshold = k, threshold
        self.best = [(np.zeros(0), np.zeros(0, dtype=object)) for _ in range(n_queries)]

    def add(self, query_units: np.ndarray, query_cases: np.ndarray, units: np.ndarray, ids: np.ndarray, cases: np.ndarray) -> None:
        for lo in range(0, len(query_units), QUERY_BLOCK):
            scores = np.round(query_units[lo:lo + QUERY_BLOCK] @ units.T, 9)
            for row, line in enumerate(scores):
                q = lo + row
                keep = np.flatnonzero((line >= self.threshold) & (cases == query_cases[q]))
                if len(keep) > self.k:
                    floor = np.partition(line[keep], len(keep) - self.k)[len(keep) - self.k]
                    keep = keep[line[keep] >= floor]
                if len(keep):
                    self._merge(q, line[keep], ids[keep])

    def _merge(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.best[q][0], scores])
        ids = np.concatenate([self.best[q][1], ids])
        order = np.lexsort((ids.astype(str), -scores))[: self.k]
        self.best[q] = (scores[order], ids[order])

    def rows(self, query_ids, query_cases):
        for q, (scores, ids) in enumerate(self.best):
            for score, item in zip(scores, ids):
                yield query_ids[q], query_cases[q], item, float(score)
