"""One large JSON value read by many tasks: the file is cut at commas, and sums over the cuts tell which commas part items.

Whether a comma lies in a string and how deep it is nested follows from the quotes and brackets before it. Each piece is
counted for both cases, as if it began outside or inside a string; the pieces before it say which one holds. Sums run inside
each byte range of a file, and one row per range carries them on, so no file passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caseloom.session import cut_lineage

RANGE = ["file", "block"]


def _nesting(text: Column) -> Column:
    count = lambda marks: F.length(text) - F.length(F.translate(text, marks, ""))
    return count("{[") - count("}]")


def _carried(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Sums of all ranges of a file before each range."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*RANGE).agg(*[c.alias(n) for n, c in sums.items()])
    return totals.select(*RANGE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, id, value, outer, inner, end_depth: the text between commas, numbered by the items of depth 1 and 2 it belongs to."""
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    # an escape never spans a comma, so it can be taken out piece by piece
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    side = lambda odd: F.array_join(F.filter(F.col("parts"), lambda p, i: i % 2 == odd), "")
    counted = cut_lineage(raw.withColumn("parts", parts).select(
        *RANGE, "id", "value", (F.size("parts") - 1).alias("quotes"), _nesting(side(0)).alias("plain"), _nesting(side(1)).alias("quoted")))
    so_far = Window.partitionBy(*RANGE).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    local = counted.withColumn("quotes_here", F.sum("quotes").over(so_far))
    swapped = (F.col("quotes_here") - F.col("quotes")) % 2 == 1
    local = local.withColumns({"out": F.when(swapped, F.col("quoted")).otherwise(F.col("plain")), "in": F.when(swapped, F.col("plain")).otherwise(F.col("quoted"))})
    local = local.withColumns({"out_here": F.sum("out").over(so_far), "in_here": F.sum("in").over(so_far)})
    ranges = local.groupBy(*RANGE).agg(F.sum("quotes").alias("q"), F.sum("out").alias("o"), F.sum("in").alias("i"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("i")).otherwise(F.col("o"))).over(before), F.lit(0)))
    placed = local.join(ranges.select(*RANGE, "inside", "depth"), RANGE)
    placed = placed.withColumn("end_depth", F.col("depth") + F.when(F.col("inside") == 1, F.col("in_here")).otherwise(F.col("out_here")))
    outside = (F.col("inside") + F.col("quotes_here")) % 2 == 0
    placed = placed.withColumns({f"border{n}": (outside & (F.col("end_depth") == n)).cast("long") for n in (1, 2)}).withColumn("open_string", ~outside)
    carried = _carried(placed, {n: F.sum(n) for n in ("border1", "border2")})
    number = lambda n: F.sum(n).over(so_far) - F.col(n) + F.col(f"{n}_before")
    return placed.join(carried, RANGE).select(*RANGE, "id", "value", number("border1").alias("outer"), number("border2").alias("inner"), "end_depth", "open_string")


def whole_files(parts: DataFrame) -> DataFrame:
    """file, top of the files whose brackets and quotes close; top is the first mark of the file."""
    first = F.min_by(F.substring(F.trim(F.translate("value", "\n\r\t﻿", "   ")), 1, 1), F.struct("block", "id"))
    end = F.max_by(F.struct("end_depth", "open_string"), F.struct("block", "id"))
    return parts.groupBy("file").agg(first.alias("top"), end.alias("end")).filter("end.end_depth = 0 and not end.open_string").select("file", "top")


def _texts(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda p: p["value"]), ",").alias("text"))


def _inside(text: Column, open_mark: str, close_mark: str, is_first: Column, is_last: Column) -> Column:
    """An item without the brackets of the value it is in."""
    text = F.when(is_first, F.regexp_replace(text, rf"^[\s﻿]*\{open_mark}", "")).otherwise(text)
    return F.when(is_last, F.regexp_replace(text, rf"\{close_mark}\s*$", "")).otherwise(text)


def members(spark: SparkSession, path: str, value: str) -> DataFrame:
    """file, key, r of files with one JSON object each, r the value read by the type `value`; files that do not close give no rows."""
    parts = cut_lineage(pieces(spark, path))
    return _members(parts, whole_files(parts).filter("top = '{'"), value)


def _members(parts: DataFrame, files: DataFrame, value: str) -> DataFrame:
    last = parts.groupBy("file").agg(F.max("outer").alias("last"))
    rows = _texts(parts.join(files.select("file"), "file", "left_semi"), "file", "outer").join(last, "file")
    own = _inside(F.col("text"), "{", "}", F.col("outer") == 0, F.col("outer") == F.col("last"))
    return rows.select("file", F.explode(F.from_json(F.concat(F.lit("{"), own, F.lit("}")), f"map<string, {value}>")).alias("key", "r"))


def records(spark: SparkSession, path: str, record: str, name: str = "data") -> DataFrame:
    """file, key, r of the records of each file: a list, an object that holds a list under `name`, or an object of records (key is its own then)."""
    parts = cut_lineage(pieces(spark, path))
    files = cut_lineage(whole_files(parts))
    heads = parts.groupBy("file", "outer").agg(F.min_by("value", F.struct("block", "id")).alias("head"), F.max("inner").alias("last_inner"), F.min("inner").alias("first_inner"))
    start = rf'^[\s﻿]*\{{?\s*"{name}"\s*:\s*\['
    held = cut_lineage(heads.join(files.filter("top = '{'"), "file").filter(F.col("head").rlike(start)).drop("head", "top"))
    inner = _texts(parts.join(held.select("file", "outer"), ["file", "outer"], "left_semi"), "file", "outer", "inner").join(held, ["file", "outer"])
    own = F.when(F.col("inner") == F.col("first_inner"), F.regexp_replace("text", start, "")).otherwise(F.col("text"))
    # the list's end, and the object's where the list is its last member
    own = F.when(F.col("inner") == F.col("last_inner"), F.regexp_replace(own, r"\]\s*\}?\s*$", "")).otherwise(own)
    none = F.lit(None).cast("string").alias("key")
    as_list = inner.select("file", none, F.from_json(own, record).alias("r"))
    last = parts.groupBy("file").agg(F.max("outer").alias("last"))
    top = _texts(parts.join(files.filter("top = '['"), "file", "left_semi"), "file", "outer").join(last, "file")
    top = top.select("file", none, F.from_json(_inside(F.col("text"), "[", "]", F.col("outer") == 0, F.col("outer") == F.col("last")), record).alias("r"))
    keyed = _members(parts, files.filter("top = '{'").join(held.select("file"), "file", "left_anti"), record)
    return as_list.unionByName(top).unionByName(keyed).filter("r is not null")
