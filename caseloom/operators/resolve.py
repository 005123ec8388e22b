"""Entity resolution: inventory, candidate pairs, accepting proposals in order, applying merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.text import prefixed_type, strip, without_type
from caseloom.operators.consolidate import edge_id
from caseloom.session import cut_lineage, top_per_key

NODE_KEY = ["case_id", "node_id"]

# Fixed values of the resolution rules.
CONFIDENCE_THRESHOLD = 0.85
INVENTORY_NEIGHBOURS = 5
SMALL_WORDS = "a an and for in of on the to".split()


def inventory(nodes: DataFrame, edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """One text line per unresolved entity of every type that has at least two of them."""
    kind = F.coalesce(F.nullif(F.lower(strip(F.col("entity_type"))), F.lit("")), F.lit("other"))
    open_nodes = nodes.join(resolved.select("case_id", F.col("source").alias("node_id")), NODE_KEY, "left_anti").withColumn("kind", kind)
    groups = open_nodes.groupBy("case_id", "kind").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("case_id", "kind")
    grouped = open_nodes.join(groups, ["case_id", "kind"], "left_semi")
    links = edges.filter("relation_type <> ''").select("case_id", "edge_id", "relation_type", F.explode(F.array(
        F.struct(F.col("src_id").alias("node_id"), F.col("tgt_id").alias("other"), F.lit(0).alias("side")),
        F.struct(F.col("tgt_id").alias("node_id"), F.col("src_id").alias("other"), F.lit(1).alias("side")))).alias("l"))
    adjacent = links.select("case_id", "edge_id", "l.node_id", "l.side", F.concat("l.other", F.lit("("), "relation_type", F.lit(")")).alias("text"))
    first = top_per_key(adjacent, NODE_KEY, [F.col("edge_id"), F.col("side")], INVENTORY_NEIGHBOURS)
    listed = first.groupBy(*NODE_KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), ", ").alias("neighbours"))
    text = strip(F.coalesce("summary", F.lit("")))
    description = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("..."))).otherwise(text)
    line = F.concat(
        F.lit("  "), "node_id", F.lit(" | type="), "kind", F.lit(" | name="), strip(F.col("label")),
        F.when(description != "", F.concat(F.lit(" | description="), description)).otherwise(""),
        F.when(F.col("neighbours").isNotNull(), F.concat(F.lit(" | neighbours=["), "neighbours", F.lit("]"))).otherwise(""),
    )
    return grouped.join(listed, NODE_KEY, "left").select(*NODE_KEY, "kind", line.alias("line"))


def compared_name(label: Column) -> Column:
    """Name as compared: no type prefix, lower case words of letters and digits."""
    words = F.regexp_extract_all(F.lower(without_type(label)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(words, " ")


def _acronyms(name: Column) -> Column:
    """Initials of a name of several words, with and without small words."""
    words = F.split(name, " ")
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    main = F.filter(words, lambda w: ~w.isin(SMALL_WORDS))
    short = F.array_join(F.transform(main, lambda w: F.substring(w, 1, 1)), "")
    kept = F.filter(F.array_distinct(F.array(initials, short)), lambda a: F.length(a) >= 2)
    return F.when(F.size(words) > 1, kept).otherwise(F.array().cast("array<string>"))


def name_pairs(nodes: DataFrame) -> DataFrame:
    """Likely duplicates of the same type: same name, acronym and full name, or names one edit apart.

    Equal names are linked to their smallest id only (a star, not all pairs). Acronyms meet names by equality.
    Names one edit apart share the text left after deleting one character; as the names are distinct, a
    text can only be shared by so many of them as one inserted character allows, however large the data. A number
    is an identity, not a spelling: only names with the same numbers in them are compared, and digits are never deleted.

    The joins are by sorting: files of names are small for their rows, and rows made of them by explode are not counted, so
    Spark would take either side for small enough to go through the driver.
    """
    named = nodes.select(*NODE_KEY, F.lower("entity_type").alias("kind"), compared_name(F.col("label")).alias("name")).filter("name <> ''")
    names = cut_lineage(named.groupBy("case_id", "kind", "name").agg(F.min("node_id").alias("lead")))
    group = ["case_id", "kind"]
    same = named.join(names.hint("merge"), [*group, "name"]).filter(F.col("node_id") != F.col("lead")).select(
        *group, F.col("lead").alias("first_id"), F.col("node_id").alias("second_id"), F.col("name").alias("first_name"), F.col("name").alias("second_name"), F.lit("same_name").alias("reason"))
    short = names.filter(~F.col("name").contains(" ")).select(*group, F.col("name").alias("acronym"), F.col("lead").alias("first_id"), F.col("name").alias("first_name"))
    full = names.select(*group, "lead", "name", F.explode(_acronyms(F.col("name"))).alias("acronym"))
    by_acronym = full.join(short.hint("merge"), [*group, "acronym"]).select(
        *group, "first_id", F.col("lead").alias("second_id"), "first_name", F.col("name").alias("second_name"), F.lit("acronym").alias("reason"))
    letters = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: ~F.substr("name", i, F.lit(1)).rlike("[0-9]"))
    shortened = F.transform(letters, lambda i: F.concat(F.substr("name", F.lit(1), i - 1), F.substr("name", i + 1)))
    numbers = F.regexp_extract_all("name", F.lit("[0-9]+"), F.lit(0))
    spelt = names.select(*group, "lead", "name", numbers.alias("numbers"), F.explode(F.array_distinct(F.concat(F.array("name"), shortened))).alias("left"))
    keys = spelt.select(*group, "lead", "name", F.xxhash64("numbers", "left").alias("key"))
    left = keys.select(*group, "key", F.col("lead").alias("first_id"), F.col("name").alias("first_name"))
    right = keys.select(*group, "key", F.col("lead").alias("second_id"), F.col("name").alias("second_name"))
    same_numbers = F.regexp_extract_all("first_name", F.lit("[0-9]+"), F.lit(0)) == F.regexp_extract_all("second_name", F.lit("[0-9]+"), F.lit(0))
    near = left.join(right.hint("merge"), [*group, "key"]).filter(
        (F.col("first_name") < F.col("second_name")) & (F.levenshtein("first_name", "second_name", 1) == 1) & same_numbers
    ).select(*group, "first_id", "second_id", "first_name", "second_name", F.lit("one_edit").alias("reason"))
    return same.unionByName(by_acronym).unionByName(near).groupBy(*group, "first_id", "second_id", "first_name", "second_name").agg(F.min("reason").alias("reason"))


def candidate_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name_pairs() with likeness of the names and the number of neighbours that both have."""
    pairs, group = cut_lineage(name_pairs(nodes)), ["case_id", "kind"]
    a, b = F.split("first_name", " "), F.split("second_name", " ")
    scored = pairs.withColumn(
        "name_similarity", 1 - F.levenshtein("first_name", "second_name") / F.greatest(F.length("first_name"), F.length("second_name"))
    ).withColumn("token_overlap", F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    return scored.join(_common_neighbours(scored, edges).hint("merge"), [*group, "first_id", "second_id"], "left").withColumn(
        "common_neighbours", F.coalesce("common_neighbours", F.lit(0)))


def _common_neighbours(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.filter(F.col("src_id") != F.col("tgt_id"))
    links = ends.select("case_id", F.col("src_id").alias("node_id"), F.col("tgt_id").alias("other")).unionByName(
        ends.select("case_id", F.col("tgt_id").alias("node_id"), F.col("src_id").alias("other"))).distinct()
    key = ["case_id", "kind", "first_id", "second_id"]
    of_first = pairs.select(*key).join(links.withColumnRenamed("node_id", "first_id").hint("merge"), ["case_id", "first_id"])
    shared = of_first.join(links.withColumnRenamed("node_id", "second_id").hint("merge"), ["case_id", "second_id", "other"], "left_semi")
    return shared.groupBy(*key).agg(F.count(F.lit(1)).alias("common_neighbours"))


def accept_proposals(proposals: DataFrame, nodes: DataFrame, resolved: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Proposals (case_id, ord, source, target, confidence) that take effect when worked off in order.

    A proposal fails once its source or target has been merged away by an earlier accepted one. Each round
    settles all proposals whose earlier rivals are settled; rounds end when none is open.
    """
    ids = nodes.select("case_id", "node_id")
    merged = resolved.select("case_id", F.col("source").alias("node_id"))

    def named(df: DataFrame, column: str, other: DataFrame, how: str) -> DataFrame:
        return df.join(other.withColumnRenamed("node_id", column), ["case_id", column], how)

    valid = proposals.withColumns({"source": strip(F.col("source")), "target": strip(F.col("target"))}).filter(
        (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")) & (F.col("confidence") >= threshold))
    for column in ("source", "target"):
        valid = named(named(valid, column, ids, "left_semi"), column, merged, "left_anti")
    undecided = cut_lineage(valid)
    accepted = cut_lineage(undecided.limit(0))
    while not undecided.isEmpty():
        first_open = undecided.groupBy("case_id", F.col("source").alias("key")).agg(F.min("ord").alias("open"))

        def earliest(df: DataFrame, column: str, name: str) -> DataFrame:
            return df.join(first_open.select("case_id", F.col("key").alias(column), F.col("open").alias(name)), ["case_id", column], "left")

        seen = earliest(earliest(undecided, "source", "_s"), "target", "_t")
        ready = cut_lineage(seen.filter((F.col("_s") == F.col("ord")) & (F.col("_t").isNull() | (F.col("_t") > F.col("ord")))).select(*undecided.columns))
        accepted = accepted.unionByName(ready)
        gone = ready.groupBy("case_id", F.col("source").alias("key")).agg(F.min("ord").alias("gone"))
        rest = undecided.join(ready.select("case_id", "ord"), ["case_id", "ord"], "left_anti")
        for column in ("source", "target"):
            hit = gone.select("case_id", F.col("key").alias(column), "gone")
            rest = rest.join(hit, ["case_id", column], "left").filter(F.col("gone").isNull() | (F.col("gone") > F.col("ord"))).drop("gone")
        undecided = cut_lineage(rest.select(*valid.columns))
    return accepted


def merge_roots(accepted: DataFrame) -> DataFrame:
    """(case_id, source, root): chains of merges followed to their end by pointer jumping."""
    current = cut_lineage(accepted.select("case_id", "source", F.col("target").alias("root")))
    while True:
        nxt = current.select("case_id", F.col("source").alias("root"), F.col("root").alias("_next"))
        jumped = current.join(nxt, ["case_id", "root"], "left")
        if jumped.filter(F.col("_next").isNotNull()).isEmpty():
            return current
        current = cut_lineage(jumped.select("case_id", "source", F.coalesce("_next", "root").alias("root")))


def merge_nodes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Surviving nodes; a type prefix in the id overrides the stored type. Degrees are to be counted anew."""
    kept = nodes.join(roots.select("case_id", F.col("source").alias("node_id")), NODE_KEY, "left_anti")
    return kept.drop("degree").withColumn("entity_type", repaired_type(F.col("node_id"), F.col("entity_type")))


def repaired_type(node_id: Column, entity_type: Column) -> Column:
    return F.coalesce(prefixed_type(strip(node_id)), entity_type)


def merged_descriptions(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Descriptions of a merged entity in long form, its own first: (case_id, node_id, member_id, summary).

    They are joined to one text only where a single entity is shown, so no merge can outgrow a row.
    """
    members = roots.select("case_id", "root", F.col("source").alias("node_id")).unionByName(
        roots.select("case_id", "root", F.col("root").alias("node_id")).distinct())
    texts = nodes.filter(F.col("summary").isNotNull()).select(*NODE_KEY, "summary")
    return members.join(texts, NODE_KEY).select("case_id", F.col("root").alias("node_id"), F.col("node_id").alias("member_id"), "summary")


def merged_sources(sources: DataFrame, roots: DataFrame) -> DataFrame:
    """Source ids of all entities after merging, in long form: a merged entity has those of its members, each once.

    sources(case_id, node_id, source_id); roots(case_id, source, root).
    """
    pointed = sources.join(roots.select("case_id", F.col("source").alias("node_id"), "root"), NODE_KEY, "left")
    return pointed.select("case_id", F.coalesce("root", "node_id").alias("node_id"), "source_id").distinct()


def merge_edges_after(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges re-pointed to the merged entities; copies fall together and links inside a merge disappear."""
    def pointed(df: DataFrame, column: str) -> DataFrame:
        hit = roots.select("case_id", F.col("source").alias(column), F.col("root").alias("_root"))
        return df.join(hit, ["case_id", column], "left").withColumn(column, F.coalesce("_root", column)).drop("_root")

    was_loop = F.col("src_id") == F.col("tgt_id")
    moved = pointed(pointed(edges.withColumn("_loop", was_loop).withColumn("_old", F.col("edge_id")), "src_id"), "tgt_id").filter(
        F.col("_loop") | (F.col("src_id") != F.col("tgt_id")))
    renamed = moved.withColumn("edge_id", edge_id(F.col("src_id"), F.col("tgt_id"), F.col("relation_type")))

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_old"))).alias(c)

    return renamed.groupBy("case_id", "edge_id", "src_id", "tgt_id", "relation_type").agg(
        *[first(c) for c in ("label", "confidence_score", "timestamp")], F.max("weight").alias("weight"))


def unknown_entities(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids named by merge requests (case_id, request_id, source, target) that are no entity of the case."""
    names = requests.select("case_id", "request_id", F.explode(F.array("source", "target")).alias("n")).select(
        "case_id", "request_id", strip(F.col("n")).alias("node_id")).filter("node_id <> ''").distinct()
    return names.join(nodes.select(*NODE_KEY), NODE_KEY, "left_anti")


def merge_requests(requests: DataFrame) -> DataFrame:
    """Distinct usable (request, source, target) rows: trimmed, without blanks and without the target itself."""
    tidy = requests.select("case_id", "request_id", strip(F.col("source")).alias("source"), strip(F.col("target")).alias("target"))
    return tidy.filter("source <> '' and target <> '' and source <> target").distinct()


def resolution_state(resolved: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state to store, one row of counts per case); a second run with the same proposals changes nothing."""
    state = resolved.select("case_id", "source", "target").unionByName(accepted.select("case_id", "source", "target"))
    n = F.count(F.lit(1))
    counts = state.groupBy("case_id").agg(n.alias("resolved_count")).join(
        accepted.groupBy("case_id").agg(n.alias("merged_count")), "case_id", "left").withColumn("merged_count", F.coalesce("merged_count", F.lit(0)))
    return state, counts.withColumn("skipped_already_resolved", F.col("resolved_count") - F.col("merged_count"))
