"""Deleting documents with everything that hangs on them, and finding what was left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import source_tokens

DOC = ["case_id", "document_id"]


def document_tokens(doomed: DataFrame, doc_status: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, document_id, token): every chunk id by which a doomed document is known.

    doc_status(case_id, document_id, chunk_id) is the exploded chunk list; chunks(case_id, document_id, chunk_id,
    alias, source_id).
    """
    listed = doc_status.join(doomed, DOC, "left_semi").select(*DOC, F.col("chunk_id").alias("token"))
    own = chunks.join(doomed, DOC, "left_semi")
    ids = own.select(*DOC, F.explode(F.array("chunk_id", "alias")).alias("token"))
    sources = own.select(*DOC, F.explode(source_tokens(F.col("source_id"))).alias("token"))
    return listed.unionByName(ids).unionByName(sources).filter("token <> ''").distinct()


def delete_rows(rows: DataFrame, doomed: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose given columns names a doomed document."""
    for column in columns:
        rows = rows.join(doomed.select("case_id", F.col("document_id").alias(column)), ["case_id", column], "left_anti")
    return rows


def delete_vectors(vectors: DataFrame, doomed: DataFrame, tokens: DataFrame, paths: DataFrame, keep_if_supported: bool = False) -> DataFrame:
    """Vector records left after a deletion.

    vectors(case_id, record_id, document_id, source_id, chunk_id, file_path); paths(case_id, document_id, file_path).
    A record goes if it names a document or any of its chunks; by file path only for documents without
    known chunks. keep_if_supported spares records that other chunks still back.
    """
    key = ["case_id", "record_id"]
    named = F.flatten(F.array(F.coalesce(source_tokens(F.col("source_id")), F.array().cast("array<string>")), F.array("chunk_id", "record_id")))
    mentioned = vectors.select(*key, F.explode(named).alias("token")).filter("token <> ''").distinct()
    gone = tokens.select("case_id", "token").distinct()
    touched = mentioned.join(gone, ["case_id", "token"], "left_semi").select(*key).distinct()
    if keep_if_supported:
        packed = vectors.select(*key, F.explode(F.filter(source_tokens(F.col("source_id")), lambda t: t != F.col("source_id"))).alias("token"))
        backed = packed.join(gone, ["case_id", "token"], "left_anti").select(*key).distinct()
        touched = touched.join(backed, key, "left_anti")
    silent = doomed.join(tokens, DOC, "left_anti")
    pathed = paths.join(silent, DOC, "left_semi").filter("file_path <> ''").select("case_id", "file_path").distinct()
    left = delete_rows(vectors, doomed, "document_id").join(touched, key, "left_anti")
    return left.join(pathed, ["case_id", "file_path"], "left_anti")


def prune_chunk_lists(links: DataFrame, tokens: DataFrame) -> DataFrame:
    """Long chunk lists (case_id, owner, chunk_id) without the deleted chunks; emptied owners disappear."""
    return links.join(tokens.select("case_id", F.col("token").alias("chunk_id")).distinct(), ["case_id", "chunk_id"], "left_anti")


def chunk_list_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("case_id", "owner").agg(F.count(F.lit(1)).alias("count"))


def orphan_documents(stores: list[DataFrame], active: DataFrame) -> DataFrame:
    """Document ids named in any store (case_id, document_id) that are no active document."""
    named = stores[0].select(*DOC)
    for store in stores[1:]:
        named = named.unionByName(store.select(*DOC))
    return named.filter("document_id <> ''").distinct().join(active.select(*DOC), DOC, "left_anti")


def drop_emptied_cases(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of cases that still have a document; the artefacts of emptied cases go as a whole."""
    return rows.join(documents.select("case_id").distinct(), "case_id", "left_semi")
