"""Near copies by DartMinHash: weighted signatures from hashed darts, banded joining, exact check, connected classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.hashing import hashed_chunks, mix, run_hashes
from caseloom.llm.words import SHINGLE
from caseloom.session import cut_lineage

SIMILARITY = 0.8
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Expected darts per text: enough that an empty coordinate is rare; texts with one are thrown again over twice the range.
DARTS = COORDINATES * (np.log(COORDINATES) + 2)
BATCH = 256
#: Slots of the table of shingle frequencies that every task holds while rest pairs are sought, 8 bytes each.
SLOTS = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every text its distinct shingle hashes, ascending, and how often each occurs; a text of fewer words is one shingle."""
    out = []
    for at, to, words, owner in hashed_chunks(texts):
        begins = np.searchsorted(owner, np.arange(to - at + 1))
        runs = run_hashes(words, SHINGLE)
        for a, b in zip(begins[:-1], begins[1:]):
            own = runs[a:b - SHINGLE + 1] if b - a >= SHINGLE else run_hashes(words[a:b], b - a) if b > a else words[:0]
            own = np.sort(own)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            out.append((own[first], np.diff(np.append(first, len(own)))))
    return out


def throw(cells: np.ndarray, owner: np.ndarray, limit: np.ndarray):
    """Darts on unit cells of weight: in every cell ranks arrive as a Poisson process of rate one, up to the owner's limit.

    Yields (dart number, owner, rank). The arrivals of a cell depend on the cell alone, so texts that share weight share darts.
    """
    rank = np.zeros(len(cells))
    arrival = cells
    while len(cells):
        arrival = arrival + GOLDEN
        drawn = mix(arrival)
        rank = rank - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
        alive = rank <= limit[owner]
        cells, arrival, owner, rank = cells[alive], arrival[alive], owner[alive], rank[alive]
        yield mix(drawn[alive] ^ GOLDEN), owner, rank


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each weighted set the dart of least rank at every coordinate; equal coordinates estimate weighted Jaccard likeness.

    Every set must have weight.
    """
    out = np.zeros((len(sets), COORDINATES), dtype=np.uint64)
    weight = np.array([c.sum() for _, c in sets], dtype=np.float64)
    left, reach = np.arange(len(sets)), 1.0
    while len(left):
        element = np.concatenate([np.repeat(sets[i][0], sets[i][1]) for i in left])
        counts = np.concatenate([sets[i][1] for i in left])
        copy = np.arange(len(element)) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = np.repeat(np.arange(len(left)), [int(weight[i]) for i in left])
        thrown = list(throw(mix(element + copy.astype(np.uint64) * GOLDEN), owner, reach * DARTS / weight[left]))
        dart, at, rank = (np.concatenate(x) for x in zip(*thrown))
        place = at * COORDINATES + (dart % np.uint64(COORDINATES)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        table, hit = np.zeros(len(left) * COORDINATES, dtype=np.uint64), np.zeros(len(left) * COORDINATES, dtype=bool)
        table[place[order]] = dart[order]  # the least rank is written last
        hit[place] = True
        full = hit.reshape(-1, COORDINATES).all(axis=1)
        out[left[full]] = table.reshape(-1, COORDINATES)[full]
        left, reach = left[~full], reach * 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLDEN, (len(signature), BANDS))
    for r in range(ROWS):
        key = mix(key + parts[:, :, r])
    return key.view(np.int64)


def banded(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bands) of every text with words."""

    def sign(batches):
        for batch in batches:
            ids, digests, texts = batch.column("doc_id"), batch.column("digest"), batch.column("text")
            for a in range(0, len(texts), BATCH):
                sets = weighted_shingles(texts.slice(a, BATCH))
                use = [i for i, (s, _) in enumerate(sets) if len(s)]
                if use:
                    keys = band_keys(signatures([sets[i] for i in use]))
                    take = pa.array([a + i for i in use])
                    yield pa.RecordBatch.from_arrays([ids.take(take), digests.take(take), pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "digest", "bands"])

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.sha2("text", 256)).alias("digest"), "text")
    return rows.mapInArrow(sign, "doc_id long, digest long, bands array<long>")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard likeness of two shingle sets."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][ia], b[1][ib]).sum())
    return shared / max(1, int(a[1].sum() + b[1].sum()) - shared)


def verified(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of doc_ids whose texts are alike enough, with their likeness."""

    def check(batches):
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                value = [likeness(x, y) for x, y in zip(weighted_shingles(part.column("text_a")), weighted_shingles(part.column("text_b")))]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(value, pa.float64())], ["a", "b", "likeness"])

    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = (
        pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    )
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, likeness double").filter(F.col("likeness") >= least).dropDuplicates(["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node of the edges (a, b), by alternating star contraction.

    Each round hangs the larger neighbours of a node, then the smaller ones, under the smallest node near it; minima
    combine on the map side, and each round's edges are written out.
    """
    ends = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = None
    while True:
        both = ends(edges)
        near = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(near, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut_lineage(small.filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size = now
    own = ends(edges).select(F.col("a").alias("node")).distinct()
    return own.join(edges.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))


def bucket_links(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) from rows (doc_id, band, key, class): every member with the first and last of its bucket, by id.

    Buckets whose members are all of one class already are passed over; no pair within a class is made.
    """
    member = F.struct("doc_id", "class")
    # written out, so that the join below can split a large bucket
    ends = cut_lineage(members.groupBy("band", "key").agg(
        F.min(member).alias("first"), F.max(member).alias("last"), F.min("class").alias("lo"), F.max("class").alias("hi"),
    ).filter("lo < hi").drop("lo", "hi"))
    met = members.join(ends, ["band", "key"]).select("doc_id", "class", F.explode(F.array("first", "last")).alias("end"))
    return met.filter(F.col("end.class") != F.col("class")).select(F.greatest("doc_id", "end.doc_id").alias("a"), F.least("doc_id", "end.doc_id").alias("b")).distinct()


def frequencies(texts: DataFrame) -> np.ndarray:
    """Number of texts per slot of shingles. It only orders shingles, rare ones first; sharing a slot costs time, not pairs."""

    def count_slots(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for own, _ in weighted_shingles(batch.column("text")):
                np.add.at(total, (own % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        for a in range(0, len(used), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(used[a:a + 50_000]), pa.array(total[used[a:a + 50_000]])], ["slot", "n"])

    got = texts.select("text").mapInArrow(count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, dtype=np.int64)
    table[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return table


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """(doc_id, class, weight, shingle, start, short): the rarest shingles of every text, in one order for all texts.

    start is the weight before the shingle in that order. Of two texts alike enough, the lighter one has a shingle of the
    other's prefix among its own marked short: otherwise the shared weight would be too small.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequencies(texts))

    def cut(batches):
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part, out = batch.slice(at, BATCH), []
                for i, (own, counts) in enumerate(weighted_shingles(part.column("text"))):
                    order = np.lexsort((own, shared.value[(own % np.uint64(SLOTS)).astype(np.int64)]))
                    weight = int(counts.sum())
                    start = np.cumsum(counts[order]) - counts[order]
                    reach = lambda share: weight - np.ceil(share * weight - 1e-9) + 1
                    n = int(np.searchsorted(start, reach(least)))
                    out.append((np.full(n, i), np.full(n, weight), own[order[:n]].view(np.int64), start[:n], start[:n] < reach(2 * least / (1 + least))))
                i, weight, shingle, start, short = (np.concatenate(x) for x in zip(*out))
                for a in range(0, len(i), 50_000):
                    piece = pa.array(i[a:a + 50_000])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(piece), part.column("class").take(piece), *(pa.array(x[a:a + 50_000]) for x in (weight, shingle, start, short))], names)

    names = ["doc_id", "class", "weight", "shingle", "start", "short"]
    return texts.select("doc_id", "class", "text").mapInArrow(cut, "doc_id long, class long, weight long, shingle long, start long, short boolean").distinct()


def rest_pairs(members: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of different classes that can be alike enough, among texts of buckets that hold several classes.

    Prefix and position filters lose no pair. A text of only common shingles meets others by its rarest ones;
    members of one class never meet each other.
    """
    several = members.groupBy("band", "key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi")
    left = members.join(several, ["band", "key"], "left_semi").select("doc_id", "class").distinct()
    left = cut_lineage(left)
    if left.isEmpty():
        return left.select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut_lineage(prefixes(texts.join(left, "doc_id"), least))
    # the most that the other text can weigh if this shingle is the first one in common
    whole = (1 + least) / least
    rows = rows.withColumn("reach", (F.col("weight") - F.col("start") + 1e-6) * whole - F.col("weight"))
    light = rows.filter("short").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "class", "weight", "reach")])
    heavy = rows.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "class", "weight", "reach")])
    # classes first, so that the copies of one class make no pairs, and only where weights and places allow one of their pairs
    of_a = light.groupBy("shingle", "class_a").agg(F.min("weight_a").alias("low_a"), F.max("reach_a").alias("far_a"))
    of_b = heavy.groupBy("shingle", "class_b").agg(F.min("weight_b").alias("low_b"), F.max("weight_b").alias("high_b"), F.max("reach_b").alias("far_b"))
    meet = of_a.join(of_b, "shingle").filter("class_a <> class_b and low_a <= far_b and low_b <= far_a and low_a <= high_b").drop("low_a", "far_a")
    both = light.join(meet, ["shingle", "class_a"]).filter("weight_a <= far_b and low_b <= reach_a and weight_a <= high_b").join(heavy, ["shingle", "class_b"])
    lighter = (F.col("weight_a") < F.col("weight_b")) | ((F.col("weight_a") == F.col("weight_b")) & (F.col("doc_id_a") < F.col("doc_id_b")))
    near = both.filter(lighter & F.expr("weight_a <= reach_b and weight_b <= reach_a"))
    return near.select(F.greatest("doc_id_a", "doc_id_b").alias("a"), F.least("doc_id_a", "doc_id_b").alias("b")).distinct()


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_of) for every row with an id: class_id is the smallest doc_id of its group of near copies.

    Equal texts (64 bits over the text and its SHA-256) are one text, known by its smallest doc_id copy_of. Texts
    meet where a band of their signatures agrees; a bucket's members are compared with its first and last member by exact
    likeness. Then the texts of buckets still of several classes are compared with every text of another class
    that can be alike enough (rest_pairs), so that no pair of a bucket stays untested.
    Null texts and texts without words are classes of their own; a repeated row has its row's class.
    """
    marked = cut_lineage(banded(docs))
    copies = cut_lineage(marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    members = copies.select("doc_id", F.posexplode("bands").alias("band", "key"))
    links, root, tried = None, None, None
    for rest in (False, True):
        if root is None:
            classed = members.withColumn("class", F.col("doc_id"))
        else:
            classed = members.join(root.withColumnsRenamed({"node": "doc_id", "root": "class"}), "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
        pairs = rest_pairs(classed, docs, least).join(tried, ["a", "b"], "left_anti") if rest else bucket_links(classed)
        tried = cut_lineage(pairs)
        found = None if tried.isEmpty() else cut_lineage(verified(tried, docs, least))
        if found is not None and not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            root = cut_lineage(components(links))
    of = marked.select("doc_id", "digest").join(copies.select("digest", F.col("doc_id").alias("copy_of")), "digest").groupBy("doc_id").agg(F.min("copy_of").alias("copy_of"))
    if root is not None:
        of = of.join(root.withColumnsRenamed({"node": "copy_of", "root": "class_id"}), "copy_of", "left")
    else:
        of = of.withColumn("class_id", F.lit(None).cast("long"))
    ids = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(of, "doc_id", "left").select("doc_id", F.coalesce("class_id", "copy_of", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def near_stage(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id; rows without an id stay."""
    copies = near_classes(docs, least).filter("doc_id <> class_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(copies, docs["doc_id"] == copies["_copy"], "left_anti")
