"""64-bit word and run hashes of whole Arrow columns at once, straight from their bytes; the same in every worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a single longer text is hashed on its own.
CHUNK_BYTES = 1 << 20
GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as needed so far."""

    base, inverse = np.uint64(GOLDEN), np.uint64(pow(GOLDEN, -1, 1 << 64))
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, CHUNK_BYTES + 1)
            cls.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, cls.base))])
            cls.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, cls.inverse))])
        return cls.up, cls.down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2^64."""
    up, down = _Powers.reach(n)
    return up[:n], down[:n]


def _hash_chunk(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of concatenated texts, and the text each word lies in; ends are the texts' ends."""
    n = len(data)
    solid = np.zeros(n + 1, dtype=bool)
    solid[:n] = ~_BLANK[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[: n - 1]
    inner = ends[ends < n]
    before[inner] = False  # a text's first byte has nothing before it
    first = np.flatnonzero(solid[:n] & ~before)
    follows = solid[1:].copy()
    follows[ends[ends > 0] - 1] = False
    last = np.flatnonzero(solid[:n] & ~follows) + 1
    up, down = _Powers.reach(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    # a polynomial over the bytes of each word, moved to a common start, with its length
    words = (total[last] - total[first]) * down[first]
    return mix(words + (last - first).astype(np.uint64) * np.uint64(GOLDEN)), np.searchsorted(ends, first, side="right")


def hashed_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, word hashes, text index of each word counted from `from`) for ranges of a string column; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        hashes, owner = _hash_chunk(data[offsets[at]:offsets[to]], offsets[at + 1:to + 1] - offsets[at])
        yield at, to, hashes, owner
        at = to


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words, as those inside texts."""
    joined = pa.array([" ".join(words)])
    return np.concatenate([h for _, _, h, _ in hashed_chunks(joined)]) if words else np.zeros(0, dtype=np.uint64)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; none when there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= np.uint64(GOLDEN)
        out += words[k:k + n]
        out ^= out >> np.uint64(29)
    return mix(out)
