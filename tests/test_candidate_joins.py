"""Joins of names do not pass through the driver: rows that explode makes are not counted by Spark's estimate."""

from caseloom.operators.resolve import name_pairs


def test_no_side_is_broadcast(spark):
    nodes = spark.createDataFrame([("c", f"n{i}", "person", f"name {chr(97 + i)} x") for i in range(20)], "case_id string, node_id string, entity_type string, label string")
    pairs = name_pairs(nodes)
    assert pairs.count() == 190  # one letter apart each
    assert "Broadcast" not in pairs._jdf.queryExecution().sparkPlan().toString()
