"""Secrets: fixed patterns, and strings in sensitive context that zstandard cannot shorten with what surrounds them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.spans import Span, digest, joined

KINDS = ("assign", "access", "hex", "novel")
# The base patterns.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words that make what follows on the line sensitive.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "private_key", "access_key", "auth_key", "bearer", "authorization")
CONTEXT = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
LEAST_CHARACTERS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{%d,}" % LEAST_CHARACTERS)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,30}")
#: Characters after a sensitive word in which a candidate may begin, and characters of surroundings on each side.
REACH, AROUND = 60, 256
#: A candidate is novel when it costs at least so many bytes, and so many per character.
LEAST_BYTES, LEAST_SHARE = 12, 0.6
#: Bound of the identifier dictionary.
DICTIONARY_BYTES = 32_768


def base_spans(text: str) -> list[Span]:
    lowered = text.lower()
    found = []
    if any(k in lowered for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Strings with letters and digits that begin soon after a sensitive word on the same line and that no base span touches.

    Of candidates with one end, where several sensitive words stand in one string, the longest counts. Strings are found once
    and looked up from each word, so the time grows with the text and not with its words times its strings.
    """
    lowered = text.lower()
    if not any(k in lowered for k in SENSITIVE):
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    run_ends = [b for _, b in runs]
    starts, ends = _merged(taken)
    found: dict[int, int] = {}
    last: dict[int, int] = {}
    for word in CONTEXT.finditer(text):
        after = word.end()
        stop = text.find("\n", after, after + REACH)
        limit = stop if stop >= 0 else after + REACH
        for k in range(bisect_right(run_ends, after), len(runs)):
            a, b = max(runs[k][0], after), runs[k][1]
            if a >= limit:
                break
            if b - a < LEAST_CHARACTERS or b in found:
                continue
            if b not in last:
                # the last place from which both a letter and a digit still follow
                digit = next((i for i in range(b - 1, a - 1, -1) if text[i].isdigit()), -1)
                letter = next((i for i in range(b - 1, a - 1, -1) if text[i].isalpha()), -1)
                last[b] = min(digit, letter)
            at = bisect_right(starts, b - 1) - 1
            if a <= last[b] and (at < 0 or ends[at] <= a):
                found[b] = a
    return sorted((a, b) for b, a in found.items())


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - AROUND):start], text[end:end + AROUND]


def identifier_counts(docs: DataFrame) -> DataFrame:
    """How often identifiers occur around the candidates of all documents."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for a, b in candidates(text, base_spans(text)) if text else ():
                    for part in surroundings(text, a, b):
                        seen.update(IDENTIFIER.findall(part))
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame) -> bytes:
    """The most frequent identifiers, most frequent last (nearest to the data), within DICTIONARY_BYTES."""
    most = identifier_counts(docs).orderBy(F.desc("n"), "word").limit(DICTIONARY_BYTES // 4).collect()
    kept, size = [], 0
    for r in most:
        size += len(r.word) + 1
        if size > DICTIONARY_BYTES:
            break
        kept.append(r.word)
    return " ".join([*SENSITIVE, *reversed(kept)]).encode()


class Novelty:
    """Bytes that a string adds to its compressed surroundings, with the identifier dictionary in place."""

    def __init__(self, words: bytes):
        import zstandard

        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8")))

    def marginal(self, before: str, value: str, after: str) -> int:
        return self.size(before + after + value) - self.size(before + after)


def find_secrets(docs: DataFrame, words: bytes | None = None) -> DataFrame:
    """Base counts, digest of the base spans and all spans of every whole text, one row per input row.

    Null and empty texts have no spans. Base spans always stay; `novel` ones never touch them. Repeated rows have the same spans,
    texts of any length are read whole; columns other than doc_id and text are left out, and an empty table gives no rows.
    """
    primed = dictionary(docs) if words is None else words

    def scan(batches):
        novelty = Novelty(primed)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                added = []
                for a, b in candidates(text, base) if text else ():
                    cost = novelty.marginal(surroundings(text, a, b)[0], text[a:b], surroundings(text, a, b)[1])
                    if cost >= LEAST_BYTES and cost >= LEAST_SHARE * (b - a):
                        added.append(("novel", a, b))
                kinds = [k for k, _, _ in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest(joined(base, KINDS)), joined(base + added, KINDS)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
