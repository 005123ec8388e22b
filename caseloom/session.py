"""Session set-up and the few helpers that need more than one column expression."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def build_session(app: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; pass master only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(shared)
    return shared


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder for tables, streams and files that a query writes."""
    return f"{ensure_checkpoint_dir(spark)}/caseloom-flow-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table in the checkpoint folder and continue from that.

    A Parquet table is written in one pass, survives lost executors, and later steps read only the columns
    and rows they need. The folder is cleared by whoever clears checkpoints.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/caseloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Row number per key in the given order, without putting one key into one task; with weight, the running sum of that column.

    Rows are range-partitioned by (keys, order), numbered inside each range, and shifted by the
    counts of the earlier ranges of the same key. The order must be total. The range id is
    checkpointed because a recomputed range split could draw its borders elsewhere.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn("_range", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.withColumn("_local", F.row_number().over(local) if weight is None else F.sum(weight).over(local))
        .join(offsets, [*keys, "_range"])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_local", "_offset", "_range")
    )


def with_next(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """df with the value of `column` in the next row of its key, null in the last one; no key is put into one task.

    df should be narrow: it is written out once. The order must be total.
    """
    placed = number_rows(df, keys, order, "_n")
    following = placed.select(*keys, (F.col("_n") - 1).alias("_n"), F.col(column).alias(name))
    return placed.join(following, [*keys, "_n"], "left").drop("_n")


def nearest_value(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, ahead: bool = True) -> DataFrame:
    """df with the next value of `column` that is not null, in the row itself or after it (or before it), within its key.

    As in number_rows, a key is cut into ranges: each finds its own values, and takes what it lacks from the ranges beyond.
    The order must be total.
    """
    ranged = cut_lineage(df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn("_range", F.spark_partition_id()))
    way = F.desc if ahead else F.asc
    so_far = Window.partitionBy(*keys, "_range").orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy(*keys).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if ahead else F.max_by
    place = F.when(F.col(column).isNotNull(), F.struct(*order))
    borders = ranged.groupBy(*keys, "_range").agg(pick(column, place).alias("_edge")).withColumn("_edge", F.last("_edge", ignorenulls=True).over(beyond))
    return (
        ranged.withColumn("_near", F.last(column, ignorenulls=True).over(so_far)).join(borders, [*keys, "_range"])
        .withColumn(name, F.coalesce("_near", "_edge")).drop("_near", "_edge", "_range")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows per key; Spark prunes to k rows per key and task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(name, F.row_number().over(window))
        .filter(F.col(name) <= k)
        .withColumn(name, F.col(name).cast("long"))
    )
