"""Keeping a table's other columns out of the way while an operator works on id, text and length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructType

OWN = ("doc_id", "text", "n_chars")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows from now on: with long texts a batch is most of what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def through_tasks(docs: DataFrame, run, results: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """docs without the columns of leave_out, beside the result columns that run(batches, names) adds in Arrow batches.

    names are those of the batches' columns to pass on. Columns of docs named like a result are replaced. Names are plain
    numbers on the way, since not every column name can be used inside a task.
    """
    added = DataType.fromDDL(results).fields
    rest = docs.select(*[F.col(_name(c)) for c in docs.columns if c not in {f.name for f in added}])
    numbered = rest.toDF(*[c if c in (*OWN, *leave_out, "ids") else f"_{i}" for i, c in enumerate(rest.columns)])
    passing = [f for f in numbered.schema.fields if f.name not in leave_out]
    names = [f.name for f in passing]
    out = numbered.mapInArrow(lambda batches: run(batches, names), StructType([*passing, *added]))
    return out.toDF(*[c for c in rest.columns if c not in leave_out], *[f.name for f in added])


def carry(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars (null where docs has none) and all other columns, whatever their names, in the struct `rest`."""
    rest = [F.col(_name(c)) for c in docs.columns if c not in OWN]
    length = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select("doc_id", "text", length.cast("long").alias("n_chars"), F.struct(*(rest or [F.lit(True).alias("none")])).alias("rest"))


def restore(carried: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order and types, from a table with those of carry()."""
    types = {f.name: f.dataType for f in docs.schema.fields}
    return carried.select(*[(F.col(c) if c in OWN else F.col("rest").getField(c)).cast(types[c]).alias(c) for c in docs.columns])
