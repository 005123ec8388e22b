"""Lines are made distinct as numbers, sources of an owner meet once."""

import re

from caseloom.operators import evidence as ev
from caseloom.plans.graph_queries import line_evidence, line_facts, line_owners
from caseloom.sources import sinks

SF = "/root/testdata/sf0.001"


def test_no_text_is_dealt_out_to_find_equal_lines(spark, capsys):
    line_evidence(spark, SF).explain()
    dealt = [line for line in capsys.readouterr().out.splitlines() if re.search(r"Exchange hashpartitioning", line)]
    assert dealt and not any("file_path" in line or "reference_id" in line for line in dealt)


def test_repeated_lines_count_once(spark):
    rows = spark.createDataFrame([("c", 1, 2, 3, 1, False), ("c", 1, 2, 3, 2, True), ("c", 9, 2, 3, 2, True)], "case_id string, l_partkey long, l_suppkey long, l_orderkey long, l_linenumber long, returned boolean")
    owners = line_owners(rows, "l_linenumber").groupBy("owner_kind").count().collect()
    assert dict(map(tuple, owners)) == {"edge": 3, "pair": 3, "entity": 1}
    assert line_facts(spark, SF).count() == line_facts(spark, SF).drop("returned").distinct().count()


def test_sources_meet_in_one_exchange(spark, capsys):
    evidence = spark.createDataFrame([("c", "edge", "e", f, r) for f, r in [("b", "2"), ("a", " 1"), ("b", "2"), (" ", "3"), ("a", "0")]], "case_id string, owner_kind string, owner_key string, file_path string, reference_id string")
    cells = sinks._cells(evidence, "edge")
    cells.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    assert [r.sources for r in cells.collect()] == ["a#1 | a#0 | b#2"] and sinks.source_list(evidence, "edge").count() == 3


def test_a_fact_without_owner_is_looked_up(spark):
    facts = spark.createDataFrame([("c", 7, "f", "k", "d", "B2")], "case_id string, line int, file_path string, reference_id string, document_id string, confidence_code string")
    chunks = spark.createDataFrame([("c", "k", "One. Two.")], "case_id string, key string, content string")
    docs = spark.createDataFrame([("c", "d", "Doc.")], "case_id string, document_id string, content string")
    row = ev.attach_snippets(facts, chunks, docs).first()
    assert (row.line, row.source_id, row.snippet) == (7, "k", "One.")
