import math
import random
from collections import Counter

from caseloom.operators.similar_names import similar_names, strong_pairs


def brute(names, percent):
    import re
    size, count = Counter(), Counter()
    for case, _, name in names:
        size[case] += 1
        count.update((case, w) for w in set(name.split(" ")))
    weight = {k: math.floor(1000 * math.log(1 + size[k[0]] / n) + 0.5) for k, n in count.items()}
    out = {}
    for c, i, a in names:
        for d, j, b in names:
            x, y = set(a.split(" ")), set(b.split(" "))
            if c == d and i < j and re.findall("[0-9]+", a) == re.findall("[0-9]+", b):
                shared, joint = sum(weight[c, w] for w in x & y), sum(weight[c, w] for w in x | y)
                if shared * 100 >= joint * percent:
                    out[c, i, j] = shared, joint
    return out


def test_all_pairs_are_found(spark):
    rng = random.Random(9)
    vocabulary = [f"w{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyzuv'[i // 26]}" for i in range(60)]
    names = set()
    while len(names) < 300:
        words = [rng.choice(vocabulary[: rng.choice([4, 12, 60])]) for _ in range(rng.randint(1, 6))]
        names.add((rng.choice(["one", "two"]), " ".join(words + [rng.choice(["", "7", "12"])]).strip()))
    rows = [(c, i, n) for i, (c, n) in enumerate(sorted(names))]
    df = spark.createDataFrame([(c, "k", i, n) for c, i, n in rows], "case_id string, kind string, name_id long, name string").repartition(4)
    for percent in (35, 60, 100):
        pairs = similar_names(df, percent)
        want = brute(rows, percent)
        got = {(r.case_id, r.first_id, r.second_id): (r.shared, r.joint) for r in pairs.collect()}
        assert got == want and (percent == 100 or len(want) > 20)
    pairs = similar_names(df, 35)
    shared = {k: v[0] for k, v in brute(rows, 35).items()}
    ends = {}
    for (c, i, j), v in shared.items():
        ends.setdefault((c, i), []).append(v)
        ends.setdefault((c, j), []).append(v)
    mean = {k: sum(v) / len(v) for k, v in ends.items()}
    want = {k for k, v in shared.items() if v >= min(mean[k[0], k[1]], mean[k[0], k[2]]) - 1e-9}
    assert {(r.case_id, r.first_id, r.second_id) for r in strong_pairs(pairs).collect()} == want


def test_a_word_of_all_names_makes_no_candidates(spark):
    """With a rare word beside it, the common one is in nobody's prefix."""
    from caseloom.operators.similar_names import prefix_entries, weighed_names

    names = spark.range(500).selectExpr("'c' as case_id", "'k' as kind", "id as name_id", "concat('common rare', translate(cast(id as string), '0123456789', 'abcdefghij')) as name")
    assert prefix_entries(weighed_names(names), 60).filter("word = 'common'").count() == 0
    assert similar_names(names, 60).count() == 0
