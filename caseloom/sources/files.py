"""Readers for the file-shaped inputs. Every reader takes a path or glob over many cases' files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.functions.text import base_name, strip
from caseloom.operators.search import is_text_file
from caseloom.schemas import LINK, LINK_NODE, VECTOR_RECORD
from caseloom.sources import json_split

GRAPHML_DATA = "data array<struct<_VALUE string, _key string>>"

# MIME type by suffix.
MIME_TYPES = {
    ".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html",
    ".json": "application/json", ".xml": "text/xml", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".zip": "application/zip",
    ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".eml": "message/rfc822",
    ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".mp4": "video/mp4", ".log": "text/plain",
}
BINARY = "application/octet-stream"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(file, entity_name, attributes), edges(file, src_id, tgt_id, attributes)) of GraphML files.

    Attribute ids are translated by the keys of their own file; blank values and loose edges drop out.
    """
    keys = _xml(spark, path, "key", "_id string, `_attr.name` string").filter("_id is not null and `_attr.name` is not null")
    per_file = keys.groupBy("file").agg(F.map_from_entries(F.collect_set(F.struct("_id", "`_attr.name`"))).alias("names"))

    def attributes(rows: DataFrame) -> DataFrame:
        named = F.transform("data", lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]).alias("k"), strip(d["_VALUE"]).alias("v")))
        kept = F.filter(named, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (p["v"] != ""))
        # the last value of a repeated attribute counts
        last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["k"] == p["k"]))
        return rows.join(per_file, "file", "left").withColumn("attributes", F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))).drop("names", "data")

    nodes = attributes(_xml(spark, path, "node", f"_id string, {GRAPHML_DATA}")).filter(F.col("_id") != "")
    edges = attributes(_xml(spark, path, "edge", f"_source string, _target string, {GRAPHML_DATA}")).filter((F.col("_source") != "") & (F.col("_target") != ""))
    return nodes.withColumnRenamed("_id", "entity_name"), edges.withColumnsRenamed({"_source": "src_id", "_target": "tgt_id"})


def attribute_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Attributes as columns, missing ones null."""
    return rows.withColumns({n: F.try_element_at("attributes", F.lit(n)) for n in names}).drop("attributes")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def kv_store(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Files with one JSON object id -> record as rows (file, key, fields); a large file is read by many tasks, one that does not close gives no rows."""
    return json_split.members(spark, path, f"struct<{_struct(record)}>").select("file", "key", "r.*")


def _struct(ddl: str) -> str:
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in _split_ddl(ddl))


def _split_ddl(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return parts + [ddl[start:]]


def vector_records(spark: SparkSession, path: str, record: str = VECTOR_RECORD) -> DataFrame:
    """Vector-store files: {"data": [...]}, an object of records (its key becomes the id), or a list; each is read by many tasks."""
    rows = json_split.records(spark, path, f"struct<{_struct(record)}>").select("file", "key", "r.*")
    return rows.withColumn("id", F.coalesce("id", "key")).drop("key")


def link_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node tables of a link-analysis export: shared columns of all kinds, the kind from the file name."""
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    kind = F.regexp_extract("_metadata.file_path", r"nodes-([a-z]+)\.csv", 1)
    names = [f.split()[0] for f in LINK_NODE.split(", ")]
    return rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names], kind.alias("kind"))


def links(spark: SparkSession, path: str) -> DataFrame:
    """Link table with its dd-MMM-yyyy dates read, unreadable ones null."""
    rows = spark.read.option("header", True).schema(LINK).csv(path)

    def date(c: str) -> Column:
        text = F.initcap(F.lower(F.col(c)))
        return F.try_to_date(text, "dd-MMM-yyyy").alias(c)

    return rows.select("node_id_start", "node_id_end", "rel_type", "link", "status", date("start_date"), date("end_date"), "sourceID")


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def text_evidence(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """Readable text files (path, size_bytes, text): text suffixes, broken bytes replaced; larger files left out only on demand."""
    mime = mime_type(F.col("path"))
    files = _binary(spark, path).filter(is_text_file(F.col("path"), mime, F.col("length"), most_bytes))
    return files.select("path", F.col("length").alias("size_bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def mime_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in MIME_TYPES]), F.array(*[F.lit(v) for v in MIME_TYPES.values()]))
    return F.coalesce(F.try_element_at(known, suffix), F.lit(BINARY))


def _glob_pattern(glob: str) -> str:
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, c if c.isalnum() or c in "_- []" else "\\" + c) for c in glob) + "$"


def casepack_manifest(spark: SparkSession, folder: str, include: tuple[str, ...] = ("*",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Visible top-level files (file_name, path, size_bytes, mime_type, sha256) that pass the globs, in name order."""
    name = base_name(F.col("path"))

    def any_glob(globs) -> Column:
        hit = F.lit(False)
        for g in globs:
            hit = hit | name.rlike(_glob_pattern(g))
        return hit

    files = _binary(spark, folder).filter(~name.startswith(".") & any_glob(include) & ~any_glob(exclude))
    rows = files.select(name.alias("file_name"), "path", F.col("length").alias("size_bytes"), mime_type(F.col("path")).alias("mime_type"), F.sha2("content", 256).alias("sha256"))
    return rows.orderBy(F.lower("file_name"), "file_name")


def cached_results(spark: SparkSession, path: str, record: str) -> DataFrame:
    """{"queries": {id: record}} or the bare object as rows (file, query_id, fields)."""
    fields = f"map<string, struct<{_struct(record)}>>"
    wrapped = F.from_json("body", f"struct<queries: {fields}>")["queries"]
    chosen = F.coalesce(wrapped, F.from_json("body", fields))
    return _whole(spark, path).select("file", F.explode(chosen).alias("query_id", "r")).filter("r is not null").select("file", "query_id", "r.*")
