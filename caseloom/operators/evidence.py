"""Provenance as a long table: (case_id, owner_kind, owner_key, file_path, reference_id, document_id, confidence_code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import base_name, first_sentence, pick_text, split_packed, strip

OWNER = ["case_id", "owner_kind", "owner_key"]
FACTS = ["file_path", "reference_id", "document_id", "confidence_code"]
SNIPPET_LIMIT = 360


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """Distinct rows that name a file and a reference; blank document ids and codes become null."""
    tidy = evidence.select(
        *OWNER, "file_path", "reference_id",
        *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("document_id", "confidence_code")],
    )
    return tidy.filter((F.col("file_path") != "") & (F.col("reference_id") != "")).dropDuplicates()


def present_documents(documents: DataFrame, files: DataFrame | None) -> DataFrame:
    """Documents whose stored file is in the file manifest; all of them when none is given."""
    known = documents.filter((F.col("document_id") != "") & (F.col("stored_file_path") != ""))
    if files is None:
        return known
    return known.join(files.select("case_id", F.col("path").alias("stored_file_path")), ["case_id", "stored_file_path"], "left_semi")


def record_evidence(records: DataFrame, documents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Evidence of records by document id and, only where that finds nothing, by file name."""
    docs = present_documents(documents, files).select(
        "case_id", "document_id", "stored_file_path", F.lower(base_name(F.col("original_filename"))).alias("file_name"),
        F.col("confidence_code").alias("_document_code"),
    )
    hinted = records.select(
        *OWNER, "reference_id", "confidence_code", F.col("record_document_id").alias("document_id"),
        "file_hint", F.lower(base_name(F.col("file_hint"))).alias("file_name"),
    )
    by_id = hinted.join(docs.drop("file_name"), ["case_id", "document_id"], "left")
    hit = F.col("stored_file_path").isNotNull()
    direct = by_id.filter(hit).select(
        *OWNER, F.col("stored_file_path").alias("file_path"),
        F.coalesce("reference_id", "document_id").alias("reference_id"), "document_id",
        F.coalesce("confidence_code", "_document_code").alias("confidence_code"),
    )
    missed = by_id.filter(~hit & (F.col("file_name") != "")).drop("document_id", "stored_file_path", "_document_code")
    named = missed.join(docs.filter(F.col("file_name") != ""), ["case_id", "file_name"]).select(
        *OWNER, F.col("stored_file_path").alias("file_path"),
        F.coalesce("reference_id", "file_hint").alias("reference_id"), "document_id",
        F.coalesce("confidence_code", "_document_code").alias("confidence_code"),
    )
    return dedupe_evidence(direct.unionByName(named))


def chunk_texts(chunks: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Chunk text by chunk id and by alias; an alias counts only for chunks that have evidence."""
    own = chunks.select("case_id", F.col("chunk_id").alias("key"), "content", F.lit(0).alias("by_alias"))
    aliased = chunks.filter(F.col("alias").isNotNull())
    if evidence is not None:
        owners = evidence.filter(F.col("owner_kind") == "chunk").select("case_id", F.col("owner_key").alias("chunk_id")).distinct()
        aliased = aliased.join(owners, ["case_id", "chunk_id"], "left_semi")
    both = own.unionByName(aliased.select("case_id", F.col("alias").alias("key"), "content", F.lit(1).alias("by_alias")))
    return (
        both.filter(F.length(strip(F.col("content"))) > 0)
        .groupBy("case_id", "key").agg(F.min_by("content", "by_alias").alias("content"))
    )


def evidence_by_chunk(records: DataFrame, chunk_evidence: DataFrame) -> DataFrame:
    """Evidence of the chunks a record's packed source ids point to."""
    pointed = records.select(*OWNER, F.explode(split_packed(F.col("source_id"))).alias("chunk_id")).distinct()
    facts = chunk_evidence.select("case_id", F.col("owner_key").alias("chunk_id"), *FACTS)
    return dedupe_evidence(pointed.join(facts, ["case_id", "chunk_id"]).drop("chunk_id"))


def mapping_evidence(full_entities: DataFrame, full_relations: DataFrame, documents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Evidence from the per-document lists of entity names and relation pairs."""
    docs = present_documents(documents, files).select(
        "case_id", "document_id", F.col("stored_file_path").alias("file_path"), F.col("document_id").alias("reference_id"), "confidence_code"
    )
    names = full_entities.select("case_id", "document_id", F.explode("entity_names").alias("name")).select(
        "case_id", "document_id", F.lit("entity").alias("owner_kind"), strip(F.col("name")).alias("owner_key")
    )
    pairs = full_relations.select("case_id", "document_id", F.explode("relation_pairs").alias("pair")).filter(F.size("pair") >= 2)
    ends = pairs.select("case_id", "document_id", strip(F.col("pair")[0]).alias("src"), strip(F.col("pair")[1]).alias("tgt"))
    related = ends.filter((F.col("src") != "") & (F.col("tgt") != "")).select(
        "case_id", "document_id", F.lit("pair").alias("owner_kind"), F.concat_ws("|", "src", "tgt").alias("owner_key")
    )
    owners = names.filter(F.col("owner_key") != "").unionByName(related).distinct()
    return dedupe_evidence(owners.join(docs, ["case_id", "document_id"]))


def attach_snippets(
    evidence: DataFrame, chunks: DataFrame, full_docs: DataFrame, owner_sources: DataFrame | None = None
) -> DataFrame:
    """Snippet of the referenced chunk, else of the owner's first known source chunk, else of the document.

    chunks(case_id, key, content); full_docs(case_id, document_id, content); owner_sources(case_id, owner_key,
    source_id, first_seen). The texts shrink to one sentence before they are shuffled. Without owner_sources a fact needs no
    owner: other columns of evidence are passed on, so a fact of several owners can be looked up once.
    """
    snippets = chunks.select("case_id", "key", first_sentence(F.col("content"), SNIPPET_LIMIT).alias("snippet"))
    whole = full_docs.select("case_id", "document_id", first_sentence(F.col("content"), SNIPPET_LIMIT).alias("_doc_snippet"))
    by_reference = snippets.select("case_id", F.col("key").alias("reference_id"), F.col("snippet").alias("_ref_snippet"), F.lit(True).alias("_ref_hit"))
    joined = evidence.join(by_reference, ["case_id", "reference_id"], "left").join(whole, ["case_id", "document_id"], "left")
    if owner_sources is None:
        joined = joined.withColumn("_src", F.lit(None).cast("struct<source_id:string,snippet:string>"))
    else:
        known = owner_sources.join(snippets.withColumnRenamed("key", "source_id"), ["case_id", "source_id"])
        first = known.groupBy("case_id", "owner_key").agg(F.min_by(F.struct("source_id", "snippet"), "first_seen").alias("_src"))
        joined = joined.join(first, ["case_id", "owner_key"], "left")
    return _shown(joined, evidence.columns)


def beside_snippets(evidence: DataFrame, reference_text: Column, document_text: Column) -> DataFrame:
    """attach_snippets() for rows that have the texts of their reference and their document at hand (null: there is none), so that nothing is looked up."""
    return _shown(evidence.select(
        "*", first_sentence(reference_text, SNIPPET_LIMIT).alias("_ref_snippet"), reference_text.isNotNull().alias("_ref_hit"),
        first_sentence(document_text, SNIPPET_LIMIT).alias("_doc_snippet"), F.lit(None).cast("struct<source_id:string,snippet:string>").alias("_src")), evidence.columns)


def _shown(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Source and snippet of joined facts: the reference's text, the owner's, the document's."""
    reference_hit = F.coalesce("_ref_hit", F.lit(False))
    chunk_snippet = F.when(reference_hit, F.col("_ref_snippet")).otherwise(F.col("_src.snippet"))
    source = F.when(reference_hit, F.col("reference_id")).otherwise(F.col("_src.source_id"))
    from_document = F.when(chunk_snippet.isNull() & F.col("_doc_snippet").isNotNull(), F.col("document_id"))
    return joined.select(
        *[c for c in columns if c not in FACTS], *FACTS,
        F.coalesce(source, from_document, F.col("reference_id")).alias("source_id"),
        F.coalesce(chunk_snippet, F.col("_doc_snippet")).alias("snippet"),
    )


def relationship_tags(edges: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Relation type, then the tags of the documents behind an edge: distinct without case, in order."""
    own = edges.select("case_id", "edge_id", strip(F.col("relation_type")).alias("tag"),
                       F.struct(F.lit("").alias("file_path"), F.lit("").alias("reference_id"), F.lit(-1).alias("pos")).alias("ord"))
    per_document = (
        evidence.filter((F.col("owner_kind") == "edge") & F.col("document_id").isNotNull())
        .groupBy("case_id", F.col("owner_key").alias("edge_id"), "document_id")
        .agg(F.min(F.struct("file_path", "reference_id")).alias("at"))
    )
    tagged = documents.filter(F.col("tags").isNotNull()).select(
        "case_id", "document_id", F.posexplode(F.split("tags", r"[;,|]")).alias("pos", "tag")
    )
    behind = per_document.join(tagged, ["case_id", "document_id"]).select(
        "case_id", "edge_id", strip(F.col("tag")).alias("tag"),
        F.struct(F.col("at.file_path"), F.col("at.reference_id"), F.col("pos")).alias("ord"),
    )
    return (
        own.unionByName(behind).filter(F.col("tag") != "")
        .groupBy("case_id", "edge_id", F.lower("tag").alias("tag_key"))
        .agg(F.min_by("tag", "ord").alias("tag"), F.min("ord").alias("first_seen"))
    )
