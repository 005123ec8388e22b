"""Plain single-process versions of the operators, by definition and without tricks."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORDS.findall(text or "")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def passages(rows, window=13):
    """kept words per (doc_id, text) row"""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if d is not None and (key not in first or d < first[key]):
                first[key] = d
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def likeness(a, b):
    bag = lambda w: Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    a, b = bag(words(a)), bag(words(b))
    both = sum((a & b).values())
    return both / max(1, a.total() + b.total() - both)


def near_classes(rows, least=0.8):
    """class id per doc_id; rows of (doc_id, text), ids unique"""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = [(d, t) for d, t in rows if words(t)]
    meet = defaultdict(set)
    for d, t in texts:
        w = words(t)
        for i in range(max(1, len(w) - 4)):
            meet[tuple(w[i:i + 5])].add(d)
    of = dict(texts)
    for a, b in {(min(x, y), max(x, y)) for ds in meet.values() for x in ds for y in ds if x != y}:
        if likeness(of[a], of[b]) >= least:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}


def spans_digest(spans, kinds):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))).encode()).hexdigest()


def personal(text):
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return found


def secret(text):
    text = text or ""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
    found = [("assign", *m.span()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sketch(text, k=128):
    """bottom-k sketch with xxhash64 (seed 42), each value hashed with the hash of the one before as its seed"""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return signed(seed)

    runs = [h[i:i + 5] for i in range(len(h) - 4)] if len(h) >= 5 else ([h] if h else [])
    return sorted({chained(r) for r in runs})[:k]


def resemblance(a, b, k=128):
    union = sorted(set(a) | set(b))[:k]
    return sum(x in set(a) and x in set(b) for x in union) / len(union) if union else 1.0
