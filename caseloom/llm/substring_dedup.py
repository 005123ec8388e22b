"""Repeated passages by suffix automata: documents stream through automata of reference shards, long matches are removed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from caseloom.llm.frames import carry, restore
from caseloom.llm.hashing import GOLDEN, hashed_chunks, mix, powers, run_hashes
from caseloom.llm.words import words_of
from caseloom.session import cut_lineage

#: Words of a window: the least length of a removed passage.
WINDOW = 13
#: Words of an anchor. The least anchor hash in a window names the shard it belongs to.
ANCHOR = 4
#: Windows of one segment at most; longer runs of windows with one anchor continue in another segment.
SEGMENT = 64


class SuffixAutomaton:
    """All substrings of the added word lists; every state knows the smallest document its strings end in."""

    def __init__(self):
        self.follow: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int) -> int:
        self.follow.append({})
        self.link.append(0)
        self.length.append(length)
        self.first.append(None)
        return len(self.follow) - 1

    def _clone(self, state: int, before: int, word: str) -> int:
        """Split the shorter strings off a state reached from `before` by `word`."""
        twin = self._state(self.length[before] + 1)
        self.follow[twin] = dict(self.follow[state])
        self.link[twin] = self.link[state]
        self.link[state] = twin
        while before >= 0 and self.follow[before].get(word) == state:
            self.follow[before][word] = twin
            before = self.link[before]
        return twin

    def add(self, words: list[str], document: int) -> None:
        last = 0
        for word in words:
            reached = self.follow[last].get(word)
            if reached is None:
                own, before = self._state(self.length[last] + 1), last
                while before >= 0 and word not in self.follow[before]:
                    self.follow[before][word] = own
                    before = self.link[before]
                if before >= 0:
                    target = self.follow[before][word]
                    self.link[own] = target if self.length[target] == self.length[before] + 1 else self._clone(target, before, word)
                last = own
            elif self.length[reached] == self.length[last] + 1:
                last = reached
            else:
                last = self._clone(reached, last, word)
            if self.first[last] is None or document < self.first[last]:
                self.first[last] = document

    def close(self) -> "SuffixAutomaton":
        """Hand the smallest documents on to the shorter strings."""
        for state in sorted(range(1, len(self.follow)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[state], self.first[state]
            if up > 0 and own is not None and (self.first[up] is None or own < self.first[up]):
                self.first[up] = own
        return self

    def statistics(self, words: list[str], most: int):
        """For each word the length of the longest match that ends in it, up to `most`, and its smallest document."""
        state, size = 0, 0
        for word in words:
            while state and word not in self.follow[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.follow[state]:
                state, size = self.follow[state][word], size + 1
            if size > most:
                size = most
            while state and self.length[self.link[state]] >= size and size:
                state = self.link[state]
            yield size, self.first[state]


def first_documents(segments: list[tuple[list[str], int]], window: int = WINDOW) -> list[list[int]]:
    """For every window of every segment the smallest document that has it, from one shard's automaton.

    A shard of one segment needs no automaton: the segment is its own match throughout.
    """
    if len(segments) == 1:
        words, document = segments[0]
        return [[document] * (len(words) - window + 1)]
    automaton = SuffixAutomaton()
    for words, document in segments:
        automaton.add(words, document)
    automaton.close()
    return [[d for n, (_, d) in enumerate(automaton.statistics(words, window)) if n >= window - 1] for words, _ in segments]


def anchored_runs(words: np.ndarray, owner: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """Runs of neighbouring windows with one anchor: (anchor, text, first window, number of windows).

    words and owner are the word hashes of several texts in order and the text of each; no window spans two texts.
    Equal windows have equal anchors.
    """
    least = run_hashes(words, anchor)
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 4
    span, wanted = 1, window - anchor + 1
    while span < wanted:
        step = min(span, wanted - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    whole = np.flatnonzero(owner[window - 1:] == owner[: len(least)])
    least, text = least[whole], owner[whole]
    if not len(whole):
        return (np.zeros(0, np.int64),) * 4
    first_word = np.searchsorted(owner, text)
    begins = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
    sizes = np.diff(np.append(begins, len(least)))
    if sizes.max() > SEGMENT:
        parts = -(-sizes // SEGMENT)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begins, ends = np.repeat(begins, parts) + nth * SEGMENT, np.repeat(begins + sizes, parts)
        sizes = np.minimum(SEGMENT, ends - begins)
    return least[begins].view(np.int64), text[begins], (whole - first_word)[begins], sizes


def run_contents(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from begin to end of each run, by differences of one running polynomial; equal words, equal hash."""
    up, down = powers(len(words) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words ^ np.uint64(GOLDEN)) * up[: len(words)])])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)).view(np.int64)


def _numbered(batch: pa.RecordBatch):
    """For ranges of a batch's texts: the word hashes, the text of each word, its first word, and per text doc_id, _row and whether it counts."""
    ids, rows = batch.column("doc_id"), batch.column("_row").to_numpy()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    for at, to, words, owner in hashed_chunks(batch.column("text")):
        yield words, owner, np.searchsorted(owner, np.arange(to - at)), ids[at:to], rows[at:to], known[at:to]


def _is_in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ascending, values), max(0, len(ascending) - 1))
    return ascending[at] == values if len(ascending) else np.zeros(len(values), dtype=bool)


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names.split())


RUNS = "anchor content doc_id _row place"


def _runs(batches, frequent: np.ndarray):
    """Runs whose anchor is not frequent; place holds the first window and, in its low byte, the number of windows less one."""
    for batch in batches:
        for words, owner, first, ids, rows, known in _numbered(batch):
            anchor, text, begin, size = anchored_runs(words, owner)
            keep = known[text] & ~_is_in(anchor, frequent)
            anchor, text, begin, size = anchor[keep], text[keep], begin[keep], size[keep]
            start = first[text] + begin
            content = run_contents(words, start, start + size + WINDOW - 1)
            yield _batch(RUNS, anchor, content, ids[text], rows[text], (begin << 8) | (size - 1))


def _frequent_windows(batches, frequent: np.ndarray):
    """The single windows of runs with a frequent anchor, by the hash of their words."""
    for batch in batches:
        for words, owner, first, ids, rows, known in _numbered(batch):
            anchor, text, begin, size = anchored_runs(words, owner)
            keep = known[text] & _is_in(anchor, frequent)
            text, begin, size = text[keep], begin[keep], size[keep]
            window = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
            text = np.repeat(text, size)
            start = first[text] + window
            content = run_contents(words, start, start + WINDOW)
            yield _batch("content doc_id _row place", content, ids[text], rows[text], window << 8)


def _segments(batches):
    """Words of the runs that stand for their shard's distinct segments."""
    for batch in batches:
        lists = batch.column("_runs")
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        anchors, contents, places = (lists.flatten().field(k).to_numpy() for k in range(3))
        ends = np.cumsum(sizes)
        texts, docs, out = batch.column("text"), batch.column("doc_id"), []
        for i in np.flatnonzero(sizes):
            words, doc = words_of(texts[i].as_py()), docs[i].as_py()
            for k in range(ends[i] - sizes[i], ends[i]):
                at, size = int(places[k]) >> 8, (int(places[k]) & 255) + 1
                out.append((anchors[k], contents[k], " ".join(words[at:at + size + WINDOW - 1]), doc))
        if out:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["anchor", "content", "segment", "lo"])


def _shards(batches):
    """Rows sorted by anchor; each anchor's segments make one automaton, through which the same segments are streamed."""

    def solved(anchor, rows):
        firsts = first_documents([(s.split(" "), lo) for _, s, lo in rows])
        return [(anchor, c, f) for (c, _, _), f in zip(rows, firsts)]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["anchor", "content", "firsts"])

    current, rows, out = None, [], []
    for batch in batches:
        for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "segment", "lo"))):
            if anchor != current:
                out += solved(current, rows)
                if len(out) > 10_000:
                    yield packed(out)
                    out = []
                current, rows = anchor, []
            rows.append(row)
    out += solved(current, rows)
    if out:
        yield packed(out)


#: One document in so many is looked at for anchors that very many documents share, and so many of those are remembered.
SAMPLE, MOST_FREQUENT = 50, 100_000
#: Times an anchor must occur in the sample to count as frequent: a shard of a rarer one has some 25 000 segments at most.
FREQUENT = 500


def frequent_anchors(numbered: DataFrame) -> np.ndarray:
    """The most frequent anchors of a sample of documents, ascending: at most MOST_FREQUENT, 8 bytes each.

    Runs of every other anchor are few and can meet in one place. The result does not depend on which anchors are found.
    """
    none = np.zeros(0, dtype=np.int64)
    sample = numbered.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLE)) == 0)
    runs = sample.mapInArrow(lambda batches: _runs(batches, none), _schema(RUNS))
    counted = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(counted.orderBy(F.desc("n"), "anchor").limit(MOST_FREQUENT).toArrow().column("anchor").to_numpy())


def _schema(names: str) -> str:
    # never null, so that joins add no filters and all uses of the runs share one shuffle
    return ", ".join(f"{n} long not null" for n in names.split())


def marked_windows(docs: DataFrame) -> DataFrame:
    """docs with _row (a hash of the text, which tells rows of one id apart) and _windows: windows that an earlier document has.

    An entry of _windows holds a first window and, in its low byte, the number of windows less one.

    1. Runs of windows meet by anchor, in numbers only. A shard whose runs all have the same words needs no automaton: all
       but its first document lose them.
    2. In other shards one run stands for each distinct segment; its words are cut out of its text and build the shard's
       automaton, through which the segments are streamed. Every run of the shard then compares its document with the
       first document of each of its windows.
    3. Anchors that a sample shows to be frequent would make large shards. Their windows are shards of their own, each of
       one segment, whose first document is a minimum that combines on the map side.
    """
    rows = docs.withColumn("_row", F.xxhash64("text"))
    numbered = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_row", "text")
    frequent = frequent_anchors(numbered)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    shard, segment = Window.partitionBy("anchor"), Window.partitionBy("anchor", "content").orderBy("doc_id", "_row", "place")
    met = (
        numbered.mapInArrow(lambda batches: _runs(batches, shared.value), _schema(RUNS))
        .withColumns({"lo": F.min("doc_id").over(shard), "hi": F.max("doc_id").over(shard), "alone": F.min("content").over(shard) == F.max("content").over(shard)})
        .filter("lo < hi")
    )
    # runs lie by anchor already, which keeps equal segments together as well
    own = met.filter("not alone").withColumn("nth", F.row_number().over(segment)).filter("nth = 1").groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_r")).agg(
        F.collect_list(F.struct("anchor", "content", "place")).alias("_runs"))
    keyed = lambda right, d, r: rows.join(right, (rows["doc_id"] == right[d]) & (rows["_row"] == right[r]), "left").drop(d, r)
    # all columns go into the tasks, so that this join and the last one read the same shuffle of the documents
    cut = keyed(own, "_doc", "_r").mapInArrow(_segments, "anchor long, content long, segment string, lo long")
    solved = cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, "anchor long, content long, firsts array<long>")
    at = F.shiftright("place", 8)
    late = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.shiftleft(at + i, 8))), lambda x: x.isNotNull())
    places = met.filter("not alone").select("anchor", "content", "doc_id", "_row", "place").join(solved, ["anchor", "content"])
    marks = places.select("doc_id", "_row", late.alias("w")).unionByName(
        met.filter("alone and lo < doc_id").select("doc_id", "_row", F.array("place").alias("w")))
    if len(frequent):
        windows = numbered.mapInArrow(lambda batches: _frequent_windows(batches, shared.value), _schema("content doc_id _row place"))
        # written out, so that the join below can split a window that very many documents have
        first = cut_lineage(windows.groupBy("content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"))
        marks = marks.unionByName(windows.join(first, "content").filter("first < doc_id").select("doc_id", "_row", F.array("place").alias("w")))
    lists = marks.filter(F.size("w") > 0).groupBy(F.col("doc_id").alias("_doc"), F.col("_row").alias("_r")).agg(F.flatten(F.collect_set("w")).alias("_windows"))
    return keyed(lists, "_doc", "_r")


def kept_words(text: str | None, windows) -> tuple[list[str], int]:
    """Words no marked window covers, and how many words the text had."""
    words = words_of(text)
    if not windows:
        return words, len(words)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    marks = np.asarray(windows, dtype=np.int64)
    np.add.at(cover, marks >> 8, 1)
    np.add.at(cover, (marks >> 8) + (marks & 255) + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist()) if not c], len(words)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    Null texts have no words; a row without a doc_id neither loses words nor takes them from others; rows of one id do
    not take from each other.
    """

    def reduce(batches):
        for batch in batches:
            rows = []
            for text, windows in zip(batch.column("text").to_pylist(), batch.column("_windows").to_pylist()):
                kept, n = kept_words(text, windows)
                rows.append((n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return marked_windows(rows).mapInArrow(reduce, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_stage(docs: DataFrame) -> DataFrame:
    """Documents without the words of repeated passages; a text that loses words is its kept words joined by blanks, others stay as they are."""
    rows = carry(docs)
    names = rows.columns

    def reduce(batches):
        for batch in batches:
            texts, sizes = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            for i, windows in enumerate(batch.column("_windows").to_pylist()):
                if windows:
                    texts[i] = " ".join(kept_words(texts[i], windows)[0])
                    sizes[i] = len(texts[i])
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return restore(marked_windows(rows).mapInArrow(reduce, rows.schema), docs)
