"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to repeated tokens."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field as default

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.frames import carry, restore, through_tasks
from caseloom.llm.spans import Span, digest, joined, overlaps
from caseloom.llm.words import WORD

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
# The base patterns. A digit run is only entered at its start, which changes no match and keeps long runs linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EVIDENCE = re.compile(r"[0-9@]")

#: Log-odds against a label where the base pattern of a kind did not match; a repeated labelled token outweighs it.
DOUBT = 5.0
CLAMP = 12.0
#: Message rounds at most, and the change in nats below which they end.
ROUNDS, SETTLED = 500, 1e-4
#: Least marginal probability of an added span, and least length of a token that repeats meaningfully.
SURE, LEAST_KEY = 0.9, 5
SMOOTH = 0.5


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each @ outwards: the local part reaches back to the last match or other character."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            low = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return found


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[::-2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    if not EVIDENCE.search(text):
        return []
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0]) if m.end() - m.start() <= 40 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


@dataclass
class Graph:
    """The tokens of a text that carry a digit, an @ or a base label; edges join neighbours and repeated tokens.

    skip joins a repeat to the occurrence before it, hub to the first labelled one of its key (or else the first), so that
    no repeat is far from a label.
    """

    tokens: list[tuple[int, int]]
    shapes: list[str]
    labels: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    hub: list[tuple[int, int]] = default(default_factory=list)


def shape(token: str, before: str) -> str:
    """Coarse form of a token: runs of digits by length, letters, and punctuation, and whether a plus sign came before."""
    out = re.sub(r"[^\W\d_]+", "a", token)
    out = re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 20)}>", out)
    out = re.sub(r"(a|<\d+>)([._%+-]\1)+", r"\1*", out)
    return f"{'+' if before.startswith('+') else ''}|{out[:24]}"


def key(token: str) -> str:
    """Similar tokens have one key: letters and digits in lower case, or the digits alone where they are most of the token."""
    plain = "".join(c for c in token.lower() if c.isalnum())
    d = digits_of(plain)
    return d if len(d) >= 4 and 2 * len(d) > len(plain) else plain


def token_graph(text: str, base: list[Span]) -> Graph:
    g = Graph([], [], [], [], [])
    spans = sorted(base, key=lambda s: s[1])
    last, before, seen, at = -1, "", defaultdict(list), 0
    for n, m in enumerate(WORD.finditer(text)):
        a, b = m.span()
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        label = next((LABELS.index(s[0]) for s in spans[at:at + 4] if s[1] < b and a < s[2]), 0)
        if label or EVIDENCE.search(m[0]):
            i = len(g.tokens)
            g.tokens.append((a, b))
            g.shapes.append(shape(m[0], before))
            g.labels.append(label)
            if last == n - 1 and i:
                g.chain.append((i - 1, i))
            last = n
            keys = {key(m[0])} | ({key(m[0].split("@")[0])} if "@" in m[0] else set())
            for k in keys:
                if len(k) >= LEAST_KEY:
                    if seen[k]:
                        g.skip.append((seen[k][-1], i))
                    seen[k].append(i)
        before = m[0]
    joined_already = set(g.skip)
    for places in seen.values():
        centre = next((i for i in places if g.labels[i]), places[0])
        for i in places:
            edge = (min(i, centre), max(i, centre))
            if i != centre and edge not in joined_already:
                joined_already.add(edge)
                g.hub.append(edge)
    return g


def statistics(docs: DataFrame) -> DataFrame:
    """Counts over all documents: (part, key, a, b, n) for shapes by label, neighbouring labels, and labels of repeated tokens."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text or not EVIDENCE.search(text):
                    continue
                g = token_graph(text, base_spans(text))
                seen.update(("shape", s, y, 0) for s, y in zip(g.shapes, g.labels))
                seen.update(("chain", "", g.labels[i], g.labels[j]) for i, j in g.chain)
                seen.update(("skip", "", int(g.labels[i] == g.labels[j]), 0) for i, j in g.skip)
            if len(seen) > 50_000:
                yield packed(seen)
                seen.clear()
        yield packed(seen)

    def packed(seen):
        rows = list(seen)
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([seen[r] for r in rows], pa.int64())], ["part", "key", "a", "b", "n"])

    return docs.select("text").mapInArrow(count, "part string, key string, a long, b long, n long").groupBy("part", "key", "a", "b").agg(F.sum("n").alias("n"))


#: Shapes with a label that the model remembers; rarer ones act like unknown shapes.
MOST_SHAPES = 20_000


@dataclass
class Field:
    unary: dict[str, np.ndarray]
    unknown: np.ndarray
    chain: np.ndarray
    agree: float


def fit(docs: DataFrame) -> Field:
    """Potentials as smoothed log-frequencies over all documents; an empty table gives a field that adds nothing."""
    counts = statistics(docs)
    labelled = counts.filter((F.col("part") == "shape") & (F.col("a") > 0)).groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(MOST_SHAPES)
    shapes = counts.filter(F.col("part") == "shape").join(labelled.select("key"), "key").collect()
    rest = counts.filter(F.col("part") != "shape").collect()
    table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LABELS)))
    for r in shapes:
        table[r.key][r.a] += r.n
    chain = np.full((len(LABELS), len(LABELS)), SMOOTH)
    same, other = 1.0, SMOOTH
    for r in rest:
        if r.part == "chain":
            chain[r.a, r.b] += r.n
        elif r.a:
            same += r.n
        else:
            other += r.n
    prior = np.array([20.0] + [SMOOTH] * len(KINDS))
    # pointwise mutual information of neighbouring labels: the unary terms already hold their frequencies
    joint = chain / chain.sum()
    return Field(
        {k: np.log((v + SMOOTH) / (v + SMOOTH).sum()) for k, v in table.items()}, np.log(prior / prior.sum()),
        np.clip(np.log(joint / (joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True))), -3, 3),
        float(np.clip(np.log(same / other), 1.0, 8.0) + DOUBT),
    )


def marginals(g: Graph, field: Field) -> np.ndarray:
    """Sum-product loopy message passing over chain, skip and hub edges until it settles; rows are tokens, columns labels.

    Base labels are evidence: many unlabelled repeats together do not outvote one.
    """
    n, k = len(g.tokens), len(LABELS)
    node = np.stack([field.unary.get(s, field.unknown) for s in g.shapes])
    given = np.array(g.labels)
    doubt = np.full(k, -DOUBT)
    doubt[0] = 0
    node = node + np.where((given > 0)[:, None], CLAMP * np.eye(k)[given], doubt)
    # many repeats pull at a hub, so what it was given holds whatever their number
    pulls = np.bincount(np.array([i for e in (*g.skip, *g.hub) for i in e], dtype=np.int64), minlength=n)
    node = node + np.where((given > 0)[:, None], (field.agree * pulls)[:, None] * np.eye(k)[given], 0)
    edges = [(i, j, 0) for i, j in g.chain] + [(i, j, 1) for i, j in (*g.skip, *g.hub)]
    if edges:
        same = field.agree * np.eye(k)
        pair = np.stack([same if s else field.chain for _, _, s in edges])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        source = np.array([i for i, _, _ in edges] + [j for _, j, _ in edges])
        target = np.array([j for _, j, _ in edges] + [i for i, _, _ in edges])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), k))
        for _ in range(ROUNDS):
            belief = node.copy()
            np.add.at(belief, target, message)
            inward = belief[source] - message[back]
            score = inward[:, :, None] + pair
            peak = score.max(axis=1)
            new = peak + np.log(np.exp(score - peak[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if change < SETTLED:
                break
        node = node.copy()
        np.add.at(node, target, message)
    node = np.exp(node - node.max(axis=1, keepdims=True))
    return node / node.sum(axis=1, keepdims=True)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans the field adds: tokens that no base span touches with a sure label."""
    base = base_spans(text)
    if not base:
        return base, []
    g = token_graph(text, base)
    if not g.skip:
        return base, []
    p = marginals(g, field)
    added = []
    for (a, b), row, given in zip(g.tokens, p, g.labels):
        y = int(row.argmax())
        if y and not given and row[y] >= SURE:
            word = text[a:b]
            a += len(word) - len(re.sub(r"^[^\w+(]+", "", word))
            b -= len(word) - len(re.sub(r"[^\w)]+$", "", word))
            if a < b and not overlaps(base, a, b):
                added.append((KINDS[y - 1], a, b))
    return base, added


def find_personal(docs: DataFrame, field: Field | None = None, keep_text: bool = False) -> DataFrame:
    """Base counts, digest of the base spans and all spans beside the columns of docs (text only on demand), one row per input row.

    Null and empty texts have no spans. Base spans always stay; added ones never touch them. Columns of docs named
    like the results are replaced.
    """
    model = fit(docs) if field is None else field
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def scan(batches, fields):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, added = all_spans(text, shared.value) if text and EVIDENCE.search(text) else ([], [])
                kinds = Counter(k for k, _, _ in base)
                rows.append((*(kinds[k] for k in KINDS), digest(joined(base, KINDS)), joined(base + added, KINDS)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*batch.select(fields).columns, *(pa.array(c, t) for c, t in zip(columns, types))], [*fields, *own])

    results = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return through_tasks(docs, scan, results, () if keep_text else ("text",))


def redact(text: str | None, spans: str) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first one counts."""
    if not spans:
        return text
    out, at = [], 0
    for part in spans.split(","):
        kind, a, b = part.split(":")
        if int(a) >= at:
            out += [text[at:int(a)], f"<{kind.upper()}>"]
        at = max(at, int(b))
    return "".join(out) + text[at:]


def personal_stage(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced and n_chars set to the new length; texts without any stay as they are."""
    rows = carry(docs)
    found = find_personal(rows, fit(docs), keep_text=True)

    def replace(batches):
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            texts = [redact(t, s) for t, s in zip(batch.column("text").to_pylist(), spans)]
            sizes = [len(t) if s else n for t, s, n in zip(texts, spans, batch.column("n_chars").to_pylist())]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    names = rows.columns
    return restore(found.mapInArrow(replace, rows.schema), docs)
