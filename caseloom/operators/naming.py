"""Unique names and slugs for whole batches of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.session import number_rows


def _with_free_numbers(requests: DataFrame, keys: list[str], taken: DataFrame) -> DataFrame:
    """Numbers 2, 3, ... per key in request order, passing over the taken numbers.

    A taken number r that is the t-th of its key has r - 1 - t free numbers before it, so merging both
    sides by that count and numbering the merged rows gives every request its free number.
    """
    asked = number_rows(requests, keys, ["ord"], "place").withColumn("is_taken", F.lit(0))
    blocked = number_rows(taken.filter("number >= 2").distinct(), keys, ["number"], "t")
    slots = blocked.select(*keys, F.col("number").alias("ord"), (F.col("number") - 1 - F.col("t")).alias("place"), F.lit(1).alias("is_taken"))
    merged = number_rows(asked.select(*keys, "ord", "place", "is_taken").unionByName(slots), keys, ["place", "is_taken", "ord"], "position")
    return merged.filter("is_taken = 0").select(*keys, "ord", (F.col("position") + 1).alias("number"))


def allocate_names(requests: DataFrame, reserved: DataFrame) -> DataFrame:
    """requests(name, type, ord), reserved(name) -> the name each request gets: name, else "name (type 2)" and so on."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    asked = requests.select("name", F.when(kind == "", "entity").otherwise(kind).alias("kind"), "ord")
    free = asked.join(reserved.select("name"), "name", "left_anti").groupBy("name").agg(F.min("ord").alias("ord"))
    first = asked.join(free, ["name", "ord"], "left_semi")
    rest = asked.join(free, ["name", "ord"], "left_anti")
    variant = r"(?s)^(.*) \((.+) (\d{1,18})\)$"
    # names given out unchanged may themselves look like a variant of another name
    held = reserved.select("name").unionByName(first.select("name"))
    taken = held.filter(F.col("name").rlike(variant)).select(
        F.regexp_extract("name", variant, 1).alias("name"), F.regexp_extract("name", variant, 2).alias("kind"),
        F.regexp_extract("name", variant, 3).try_cast("long").alias("number"),
    )
    numbered = _with_free_numbers(rest, ["name", "kind"], taken)
    suffixed = F.concat("name", F.lit(" ("), "kind", F.lit(" "), F.col("number").cast("string"), F.lit(")"))
    return first.select("ord", "name", F.col("name").alias("unique_name")).unionByName(numbered.select("ord", "name", suffixed.alias("unique_name")))


def allocate_slugs(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests(slug, ord), existing(slug) -> the slug each request gets: slug, else slug-2, slug-3 and so on."""
    free = requests.join(existing.select("slug"), "slug", "left_anti").groupBy("slug").agg(F.min("ord").alias("ord"))
    first = requests.join(free, ["slug", "ord"], "left_semi")
    rest = requests.join(free, ["slug", "ord"], "left_anti")
    variant = r"^(.*)-(\d{1,18})$"
    held = existing.select("slug").unionByName(first.select("slug"))
    taken = held.filter(F.col("slug").rlike(variant)).select(
        F.regexp_extract("slug", variant, 1).alias("slug"), F.regexp_extract("slug", variant, 2).try_cast("long").alias("number"))
    numbered = _with_free_numbers(rest, ["slug"], taken)
    return first.select("ord", "slug", F.col("slug").alias("unique_slug")).unionByName(
        numbered.select("ord", "slug", F.concat_ws("-", "slug", F.col("number").cast("string")).alias("unique_slug")))
