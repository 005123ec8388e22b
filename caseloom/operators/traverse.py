"""K-hop neighbourhoods by repeated joins of the frontier with the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.session import cut_lineage


def khop_nodes(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within the given number of undirected hops of the seeds.

    seeds holds node_id, case_id and any further columns that name a question; the result adds hop.
    Every hop reads the checkpointed nodes seen so far, and the loop stops once a hop adds nothing.
    """
    keys = [c for c in seeds.columns if c != "node_id"]
    links = edges.select("case_id", "src_id", "tgt_id").filter(F.col("src_id") != F.col("tgt_id"))
    both = links.select("case_id", F.col("src_id").alias("node_id"), F.col("tgt_id").alias("next_id")).unionByName(
        links.select("case_id", F.col("tgt_id").alias("node_id"), F.col("src_id").alias("next_id"))
    )
    seen = cut_lineage(seeds.distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        reached = (
            seen.filter(F.col("hop") == hop - 1).drop("hop")
            .join(both, ["case_id", "node_id"])
            .select(*keys, F.col("next_id").alias("node_id"))
            .distinct()
        )
        fresh = cut_lineage(reached.join(seen.drop("hop"), [*keys, "node_id"], "left_anti").withColumn("hop", F.lit(hop)))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose two ends are both members; members may carry question columns besides case_id and node_id."""
    extra = [c for c in members.columns if c not in ("case_id", "node_id", "hop")]
    inside = members.select("case_id", *extra, "node_id").distinct()
    # a table of a few rows: edges of other cases go before anything is shuffled
    cases = cut_lineage(members.select("case_id").distinct())
    first = edges.join(cases, "case_id", "left_semi").join(inside.withColumnRenamed("node_id", "src_id"), ["case_id", "src_id"])
    return first.join(inside.withColumnRenamed("node_id", "tgt_id"), ["case_id", *extra, "tgt_id"], "left_semi")
