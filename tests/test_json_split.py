import json
import random

import pytest

from caseloom.sources import json_split

RECORD = "struct<id: string, n: int, v: array<double>, o: map<string, string>>"


@pytest.fixture()
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, i):
    text = "".join(rng.choice('ab,{}[]":\\/ é漢\n\t') for _ in range(rng.randint(0, 30)))
    return {"id": f"i{i}{text}", "n": i, "v": [round(rng.random(), 6) for _ in range(rng.randint(0, 6))], "o": {text: text + "\\", "k": "}],"}}


def plain(r):
    return None if r is None else json.dumps([r.id, r.n, list(r.v), dict(r.o)], sort_keys=True)


def test_every_layout_in_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(11)
    items = [value(rng, i) for i in range(300)]
    layouts = {
        "object.json": json.dumps({f"key,\"{{{i}": x for i, x in enumerate(items)}, ensure_ascii=False),
        "indented.json": json.dumps({f"k{i}": x for i, x in enumerate(items)}, indent=2),
        "list.json": json.dumps(items), "held.json": json.dumps({"dim": 3, "data": items, "matrix": "a,b]"}), "only.json": json.dumps({"data": items}, indent=1),
        "broken.json": json.dumps(items)[:-9], "none.json": "", "empty.json": "{}", "no.json": "[]", "bare.json": json.dumps({"data": []}),
    }
    for name, text in layouts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    path = str(tmp_path)
    assert spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions() > 50
    got = {}
    for r in json_split.records(spark, path, RECORD).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.key, plain(r.r)))
    want = sorted(json.dumps([x["id"], x["n"], x["v"], x["o"]], sort_keys=True) for x in items)
    assert set(got) == {"object.json", "indented.json", "list.json", "held.json", "only.json"}
    for name, rows in got.items():
        assert sorted(v for _, v in rows) == want, name
        assert all((k is None) == (name in ("list.json", "held.json", "only.json")) for k, _ in rows)
    keys = {k for k, _ in got["object.json"]}
    assert keys == {f"key,\"{{{i}" for i in range(300)}


def test_members_of_one_object(spark, tmp_path, small_ranges):
    store = {f"k{i}": {"id": "x" * (i % 50), "n": i, "v": [], "o": {}} for i in range(500)}
    (tmp_path / "store.json").write_text(json.dumps(store))
    got = {r.key: (r.r.id, r.r.n) for r in json_split.members(spark, str(tmp_path), RECORD).collect()}
    assert got == {k: (v["id"], v["n"]) for k, v in store.items()}
