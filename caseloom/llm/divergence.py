"""Audit of sources: how the words of a source differ from its language's, and sources from each other.

White-space chunks are counted per document, each distinct chunk of the corpus is parted into its terms once, and the terms
are joined back to the counts. In how many documents a term lies follows from its chunks for nearly all terms: at least as
many as its most frequent chunk, at most as many as all of them together. Only where that leaves it open are the documents
looked at again, for chunks that each lie in fewer documents than the threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.session import cut_lineage, top_per_key

#: A language keeps the terms of at least so many of its documents.
LEAST_DOCS = 30
TOP_TERMS = 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Cells of one block of terms and sources that a task compares.
BLOCK_CELLS = 1 << 20
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A filter of so many bits, as a power of two, keeps chunks that need no second look from being dealt out; its size is fixed.
FILTER_BITS = 24
#: Spark's seed of xxhash64.
SEED = 42


def _cuts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end of all."""
    if not len(ordered):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])


class _Batch:
    """The chunks of a batch: keys are (language, chunk, document) in order, counts how often the chunk is in the document."""

    def __init__(self, batch: pa.RecordBatch):
        self.lang = pc.fill_null(batch.column("lang"), "").dictionary_encode()
        words = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
        owner = pc.list_parent_indices(words).to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        self.chunks = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int64)
        blank = pc.index_in(pa.scalar(""), self.chunks).as_py()
        if blank is not None:
            owner, codes = owner[codes != blank], codes[codes != blank]
        self.rows, self.size = max(1, len(batch)), max(1, len(self.chunks))
        own = self.lang.indices.to_numpy().astype(np.int64)
        self.keys, self.counts = np.unique((own[owner] * self.size + codes) * self.rows + owner, return_counts=True)

    def langs(self, pairs: np.ndarray) -> pa.Array:
        return self.lang.dictionary.take(pa.array(pairs // self.size))

    def names(self, pairs: np.ndarray) -> pa.Array:
        return self.chunks.take(pa.array(pairs % self.size))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])


def chunk_counts(docs: DataFrame) -> DataFrame:
    """Per batch of documents, language and chunk: documents, and occurrences by source.

    Chunks are what ASCII white space parts. Every language of a batch also has a row of the empty chunk with all its sources,
    so that groups without text are known.
    """

    def run(batches):
        for batch in batches:
            b = _Batch(batch)
            source = pc.fill_null(batch.column("source"), "").dictionary_encode()
            of, n = source.indices.to_numpy().astype(np.int64), max(1, len(source.dictionary))
            pairs = b.keys // b.rows
            cuts = _cuts(pairs)
            at = pairs[cuts[:-1]]
            # the documents of a chunk by their source
            by_source = pairs * n + of[b.keys % b.rows]
            order = np.argsort(by_source, kind="stable")
            by_source = by_source[order]
            parts = _cuts(by_source)
            sums = np.add.reduceat(b.counts[order], parts[:-1]) if len(at) else np.zeros(0, dtype=np.int64)
            heads = by_source[parts[:-1]]
            groups = np.unique(b.lang.indices.to_numpy().astype(np.int64) * n + of)
            known = _cuts(groups // n)
            sources = np.concatenate([heads % n, groups % n])
            borders = pa.array(np.concatenate([np.searchsorted(heads // n, at), len(heads) + known]), pa.int32())
            empty = len(known) - 1
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([b.langs(at), b.lang.dictionary.take(pa.array(groups[known[:-1]] // n))]),
                pa.concat_arrays([b.names(at), pa.array([""] * empty, pa.string())]),
                pa.array(np.concatenate([np.diff(cuts), np.zeros(empty, dtype=np.int64)])),
                pa.ListArray.from_arrays(borders, source.dictionary.take(pa.array(sources))),
                pa.ListArray.from_arrays(borders, pa.array(np.concatenate([sums, np.zeros(len(groups), dtype=np.int64)]))),
            ], ["lang", "chunk", "n_docs", "sources", "counts"])

    return _texts(docs).mapInArrow(run, "lang string, chunk string, n_docs long, sources array<string>, counts array<long>")


def chunk_terms(rows: DataFrame) -> DataFrame:
    """lang, chunk, term, n_docs: every distinct chunk parted once, a term as often as the chunk holds it.

    Terms are runs of letters and non-ASCII characters, only A-Z lowered; n_docs are the chunk's documents in the language.
    Rows are dealt out by chunk, of which a batch has one row, so that no chunk is frequent there.
    """
    counted = rows.filter(F.col("chunk") != "").select("lang", "chunk", "n_docs").repartition("chunk").groupBy("chunk", "lang").agg(F.sum("n_docs").alias("n_docs"))
    whole = counted.groupBy("chunk").agg(F.collect_list(F.struct("lang", "n_docs")).alias("langs"))
    words = F.regexp_extract_all(F.translate("chunk", CAPITALS, CAPITALS.lower()), F.lit(TERM), F.lit(0))
    return whole.select("chunk", "langs", F.explode(words).alias("term")).select("chunk", "term", F.inline("langs"))


def _filter_of(chunks: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of every chunk."""
    place = F.xxhash64("chunk").bitwiseAND(F.lit((1 << bits) - 1))
    words = chunks.select(F.shiftright(place, 3).alias("byte"), F.call_function("shiftleft", F.lit(1), (place % 8).cast("int")).alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    found = words.toPandas()
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    out[found["byte"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.uint8)
    return out


def documents_with(docs: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """lang, term, doc: numbers of the documents that hold one of the chunks of wanted(lang, chunk, term)."""
    held = _filter_of(wanted, bits)

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            b = _Batch(batch)
            hashes = np.fromiter((xxhash.xxh64_intdigest(c, SEED) & ((1 << bits) - 1) for c in b.chunks.cast(pa.binary()).to_pylist()), dtype=np.int64, count=len(b.chunks))
            asked = (held[hashes >> 3] >> (hashes & 7).astype(np.uint8)) & 1 == 1
            keys = b.keys[asked[b.keys // b.rows % b.size]] if len(b.chunks) else b.keys
            pairs = keys // b.rows
            yield pa.RecordBatch.from_arrays([b.langs(pairs), b.names(pairs), pa.array(row + keys % b.rows)], ["lang", "chunk", "doc"])
            row += len(batch)

    rows = _texts(docs).mapInArrow(run, "lang string, chunk string, doc long")
    return rows.join(wanted, ["lang", "chunk"]).select("lang", "term", "doc").distinct()


def kept_terms(docs: DataFrame, terms: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, term) of the terms in at least `least` documents of a language, and the rows (lang, chunk, term) of their chunks.

    terms as those of chunk_terms().
    """
    bounds = terms.groupBy("lang", "term").agg(F.max("n_docs").alias("low"), F.sum("n_docs").alias("high")).filter(F.col("high") >= least)
    bounds = cut_lineage(bounds.select("lang", "term", (F.col("low") >= least).alias("sure")))
    forms = cut_lineage(terms.select("lang", "chunk", "term").join(bounds, ["lang", "term"]))
    open_forms = forms.filter("not sure").select("lang", "chunk", "term").distinct()
    found = documents_with(docs, cut_lineage(open_forms)).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    kept = cut_lineage(bounds.filter("sure").select("lang", "term").unionByName(found.select("lang", "term")))
    return kept, forms.join(kept, ["lang", "term"], "left_semi").select("lang", "chunk", "term")


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * n_terms)), exact."""
    up = (F.lit(SCALE).cast("decimal(12,0)") * (count + SMOOTH).cast("decimal(20,0)")).alias("up")
    return F.call_function("div", up, (total + SMOOTH * n_terms).cast("decimal(20,0)")) + 1


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language: the differences of their shares, over all kept terms.

    Terms are dealt to blocks, so that terms times sources of a block stay below a bound; a block is one small matrix.
    """
    per_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("_sources"), F.max("n_terms").alias("_terms"))
    blocks = per_lang.select("lang", F.greatest(F.lit(1), F.ceil(F.col("_sources") * F.col("_terms") / BLOCK_CELLS)).cast("int").alias("blocks"))
    sized = groups.join(blocks, "lang")
    # where a language has no kept term the share of zero has no total to divide by
    zero = F.when(F.col("n_terms") > 0, share(F.lit(0), F.col("total"), F.col("n_terms"))).otherwise(0)
    sides = sized.select("lang", "source", zero.alias("zero"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = counts.join(sized.select("lang", "source", "total", "n_terms", "blocks"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"),
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = sorted(left["source"])
        zero = left.set_index("source")["zero"].loc[names].to_numpy(dtype=np.int64)
        codes, terms = pd.factorize(right["term"])
        table = np.repeat(zero[:, None], len(terms), axis=1)
        table[pd.Index(names).get_indexer(right["source"]), codes] = right["p"].to_numpy(dtype=np.int64)
        out = []
        for k, name in enumerate(names):
            far = np.abs(table - table[k]).sum(axis=1)
            out.append(pd.DataFrame({"lang": left["lang"].iloc[0], "source": name, "item": names, "value": far}).drop(index=k))
        return pd.concat(out)

    parts = sides.groupBy("lang", "block").cogroup(cells.groupBy("lang", "block")).applyInPandas(compare, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for docs(text, lang, source).

    Part pair: every other source of the language with the sum of differences of shares over the language's kept terms.
    Part term: the terms whose share in the source passes that in the language most, at most `top`. Ranks count from 1 by
    value, greatest first, then by the item's bytes. Null texts, languages and sources are empty ones; a group without
    terms has its pairs, and with no kept term in the language all of them are 0; repeated rows are documents of their own; an
    empty table gives no rows. Other columns are left out.
    """
    rows = cut_lineage(chunk_counts(docs))
    kept, forms = kept_terms(docs, cut_lineage(chunk_terms(rows)), least)
    held = rows.join(forms, ["lang", "chunk"]).select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("s"))
    counts = cut_lineage(held.groupBy("lang", F.col("s.sources").alias("source"), "term").agg(F.sum("s.counts").alias("n")))
    n_terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut_lineage(
        rows.filter(F.col("chunk") == "").select("lang", F.explode("sources").alias("source")).distinct().join(totals, ["lang", "source"], "left").join(n_terms, "lang", "left")
        .fillna(0, ["total", "n_terms"]))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    above = (
        counts.join(of_lang, ["lang", "term"]).join(groups.join(whole, "lang"), ["lang", "source"])
        .withColumn("value", share(F.col("n"), F.col("total"), F.col("n_terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")))
        .filter(F.col("value") > 0).select("lang", "source", F.col("term").alias("item"), "value")
    )
    order = [F.desc("value"), "item"]
    best = top_per_key(above, ["lang", "source"], order, top).withColumn("part", F.lit("term"))
    pairs = top_per_key(_pairs(counts, groups), ["lang", "source"], order, (1 << 31) - 1).withColumn("part", F.lit("pair"))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
