"""One query per operator over the whole of its table, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.llm import (
    byte_bpe, divergence, fingerprints, language_id, near_dedup, packing, pii, quality, resampling, secrets, sentencepiece, substring_dedup, toxicity,
)
from caseloom.llm.frames import small_batches

#: Folder of the public tokenizer files; None takes that of the installed package.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.deduplicated(documents(spark, sf))


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_personal(documents(spark, sf).select("doc_id", "text"))


def op4_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf)).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf))


def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf))


def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every whole text, a digest of their ids, and whether decoding gives the text back."""
    small_batches(spark)
    path = tokenizer_path("piece_bpe_32k.model")
    rows = sentencepiece.decode(sentencepiece.encode(documents(spark, sf).select("doc_id", "text"), path), path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, fold(5) != 0)
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf), tokenizer_path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(documents(spark, sf))


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Number of ids of every whole text, a digest of them, and a digest of the bytes they stand for."""
    small_batches(spark)
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(documents(spark, sf).select("doc_id", "text"), path), path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    return resampling.resample(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")).drop("n_words")


def op13_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_substring_dedup, op3_pii, op4_near_dedup, op5_secrets, op6_fingerprints, op7_sentencepiece, op8_toxicity, op9_packing, op10_quality,
    op11_byte_bpe, op12_importance_resampling, op13_source_divergence,
)}


def _quality_sql() -> str:
    stops = ", ".join(f"'{v}'" for v in sorted({v for w in quality.STOP_WORDS for v in (w, w.capitalize())}))
    tests = []
    for r in quality.RULES:
        value = r.ratio.replace("/ n_words", "/ nullif(n_words, 0)").replace("n_words / greatest", "n_words * 1.0 / greatest")
        tests += [f"coalesce({value} >= {r.low}, false)"] if r.low is not None else []
        tests += [f"coalesce({value} <= {r.high}, false)"] if r.high is not None else []
    return rf"""
    with base as (
        select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
        from documents),
    windows as (
        select doc_id, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') as win
        from (select doc_id, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) as i from base)),
    twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from windows) where n > 1),
    covered as (select doc_id, count(distinct i + k) as n from twice, range({quality.WINDOW}) as r(k) group by doc_id),
    counts as (
        select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
               length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')) as n_symbols, len(lines) as n_lines,
               len(lines) - len(list_distinct(lines)) as n_dup_lines, len(list_filter(words, lambda w: w in ({stops}))) as n_stop_words,
               coalesce(n, 0) as n_repeat_words
        from base left join covered using (doc_id))
    select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
           not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and {' and '.join(tests)} as kept
    from counts"""


PASSAGES_SQL = rf"""
    with base as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
    windows as (
        select doc_id, i, array_to_string(words[i:i + {substring_dedup.WINDOW - 1}], ' ') as win
        from (select doc_id, words, unnest(range(1, len(words) - {substring_dedup.WINDOW - 2})) as i from base)),
    late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by win) as first from windows) where first < doc_id),
    covered as (select distinct doc_id, i + k as i from late, range({substring_dedup.WINDOW}) as r(k)),
    kept as (
        select w.doc_id, string_agg(w.word, ' ' order by w.i) as text, count(*) as n
        from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from base) w
        anti join covered c on w.doc_id = c.doc_id and w.i = c.i group by w.doc_id)
    select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
    from base left join kept using (doc_id)"""


# CRC-32 of every distinct word from its bytes and the table of the reversed polynomial
RESAMPLING_SQL = rf"""
    with entries as (
        select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, {resampling.POLYNOMIAL}) else c >> 1 end) order by i) as entry
        from range(256) as r(i)),
    texts as (
        select true as own, row_number() over () as r, doc_id, text from documents
        union all select false, row_number() over (), null, text from benchmark),
    words as (
        select own, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
        from texts),
    hexes as (select word, hex(encode(word)) as h from (select distinct word from words)),
    buckets as (
        select word, xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
            lambda c, b: xor(c >> 8, entry[xor(c & 255, b) + 1]))) % {resampling.BUCKETS} as bucket
        from hexes, entries),
    counts as (select bucket, count(*) filter (own) as s, count(*) filter (not own) as t from words join buckets using (word) group by bucket),
    totals as (select sum(s)::double as all_s, sum(t)::double as all_t from counts),
    gains as (
        select bucket, floor(1000.0::double * ln((t + 1)::double * (all_s + {resampling.BUCKETS}) / ((s + 1)::double * (all_t + {resampling.BUCKETS}))))::bigint as gain
        from counts, totals),
    weights as (select r, count(*) as n_features, sum(gain)::bigint as weight from words join buckets using (word) join gains using (bucket) where own group by r),
    scored as (
        select r, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000.0::double * ln(-ln(
            (('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
        from texts left join weights using (r) where own),
    ranked as (
        select r, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= {resampling.LEAST_WORDS})
    select doc_id, n_features, weight, score, case when rank <= {resampling.PERCENT} * n // 100 then rank end as rank
    from scored left join ranked using (r)"""

DIVERGENCE_SQL = rf"""
    with base as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
    terms as (
        select d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from base),
    kept as (select lang, term from terms group by lang, term having count(distinct d) >= {divergence.LEAST_DOCS}),
    sizes as (select lang, count(*) as v from kept group by lang),
    groups as (select distinct lang, source from base),
    counted as (select lang, source, term, count(*) as n from terms semi join kept using (lang, term) group by lang, source, term),
    grid as (
        select g.lang, g.source, k.term, coalesce(n, 0) as n, v, sum(coalesce(n, 0)) over (partition by g.lang, g.source) as total
        from groups g join kept k using (lang) join sizes using (lang) left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    shares as (select lang, source, term, n, v, 1 + ({divergence.SCALE}::hugeint * (n + {divergence.SMOOTH})) // (total + {divergence.SMOOTH} * v)::hugeint as p from grid),
    whole as (
        select lang, term, 1 + ({divergence.SCALE}::hugeint * (sum(n) + {divergence.SMOOTH})) // (sum(sum(n)) over (partition by lang) + {divergence.SMOOTH} * max(v))::hugeint as q
        from shares group by lang, term),
    pairs as (
        select a.lang, a.source, b.source as item, coalesce(sum(abs(p.p - o.p)), 0)::bigint as value
        from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join shares p on p.lang = a.lang and p.source = a.source
        left join shares o on o.lang = a.lang and o.source = b.source and o.term = p.term
        group by a.lang, a.source, b.source),
    above as (select lang, source, term as item, (p - q)::bigint as value from shares join whole using (lang, term) where n > 0 and p > q),
    ranked as (
        select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
        union all
        select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from above)
    select * from ranked where part = 'pair' or rank <= {divergence.TOP_TERMS}"""


ORACLE = {
    "op2_substring_dedup": PASSAGES_SQL, "op10_quality": _quality_sql(), "op12_importance_resampling": RESAMPLING_SQL, "op13_source_divergence": DIVERGENCE_SQL,
}
