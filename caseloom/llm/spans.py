"""Spans found in texts: their order, their written form and its digest."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind in the given order, comma-joined; code points, end exclusive."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def overlaps(spans: list[Span], start: int, end: int) -> bool:
    return any(a < end and start < b for _, a, b in spans)
