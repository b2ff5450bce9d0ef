"""Joins and selections against brute force on small random tables, with ties, nulls, repeats and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from evalloom.operators import distribution, greedy, joins, sequences, splits, windows


@pytest.fixture
def rng():
    return random.Random(7)


def test_band_pairs(spark, rng):
    rows = [(rng.randint(0, 2), i, round(rng.uniform(-5, 5), 2)) for i in range(80)] + [(0, 90, None), (None, 91, 1.0)]
    got = {(r["id_a"], r["id_b"]) for r in joins.band_pairs(spark.createDataFrame(rows, "g int, i int, v double"), "g", "i", "v", 0.7).collect()}
    clean = [r for r in rows if None not in r]
    assert got == {(a[1], b[1]) for a in clean for b in clean if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 0.7}


def test_nearest_on_line(spark, rng):
    probes = [(rng.randint(0, 3), i, round(rng.uniform(0, 10), 1)) for i in range(60)] + [(0, 99, None)]
    points = [(rng.randint(0, 2), i, round(rng.uniform(0, 10), 1)) for i in range(25)] + [(1, 77, None)]
    got = joins.nearest_on_line(spark.createDataFrame(probes, "g int, p int, v double"), "p", "v", spark.createDataFrame(points, "g int, q int, w double"), "q", "w", ["g"])
    expected = {}
    for g, p, v in probes:
        near = [(abs(v - w), w, q) for h, q, w in points if h == g and w is not None and v is not None]
        if near:
            expected[p] = min(near)[2]
    assert {r["p"]: r["q"] for r in got.collect()} == expected


def test_boxes_and_pareto(spark, rng):
    points = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(60)]
    boxes = [(i, a, a + rng.uniform(0, 4), b, b + rng.uniform(0, 4)) for i in range(20) for a, b in [(rng.uniform(0, 9), rng.uniform(0, 9))]]
    got = joins.in_boxes(spark.createDataFrame(points, "i int, x double, y double"), ["x", "y"], spark.createDataFrame(boxes, "b int, x_min double, x_max double, y_min double, y_max double"), "b", 1.5)
    assert {(r["i"], r["b"]) for r in got.collect()} == {(p[0], b[0]) for p in points for b in boxes if b[1] <= p[1] <= b[2] and b[3] <= p[2] <= b[4]}
    rows = [(i, float(rng.randint(0, 8)), float(rng.randint(0, 8))) for i in range(50)] + [(60, None, 1.0)]
    front = {r["i"] for r in joins.pareto_frontier(spark.createDataFrame(rows, "i int, x double, y double"), "i", "x", "y").collect()}
    clean = [r for r in rows if r[1] is not None]
    assert front == {a[0] for a in clean if not any(b[1] >= a[1] and b[2] >= a[2] and (b[1] > a[1] or b[2] > a[2]) for b in clean)}
    empty = spark.createDataFrame([], "i int, x double, y double")
    assert joins.pareto_frontier(empty, "i", "x", "y").count() == 0


def test_reuse_lookups_and_checks(spark):
    wanted = spark.createDataFrame([("g", "a", None), ("g", "b", 1.0), ("h", "c", 1.0)], "grp string, k string, x double")
    there = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "k string, x double")
    assert {r["grp"]: (r["wanted"], r["reused"]) for r in joins.reuse_ratio(wanted, there, "grp", ["k", "x"]).collect()} == {"g": (2, 1), "h": (1, 0)}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "k string, at int, v string")
    assert joins.last_wins(rows, ["k"], "at", ["v"]).head()["v"] == "z" and joins.first_wins(rows, ["k"], "at", ["v"]).head()["v"] == "x"
    with pytest.raises(ValueError, match="repeated"):
        joins.require_unique(rows, ["k"])
    with pytest.raises(ValueError, match="not in the index"):
        joins.require_present(rows, "v", spark.createDataFrame([("x",)], "path string"), "path")
    kids = joins.ordered_children(spark.createDataFrame([("g", ["c2", "c1", "c9"])], "g string, ids array<string>"), "g", "ids", spark.createDataFrame([("c1", 1), ("c2", 2)], "c string, n int"), "c", ["n"])
    assert [(r["position"], r["n"]) for r in kids.orderBy("position").collect()] == [(0, 2), (1, 1)]


def test_water_fill_and_quotas(spark, rng):
    def filled(rows, total):
        left = {}
        for b, i in sorted(rows):
            left.setdefault(b, []).append(i)
        taken, count = [], dict.fromkeys(left, 0)
        while len(taken) < total and any(left.values()):
            b = min((b for b in left if left[b]), key=lambda b: (count[b], b))
            taken.append(left[b].pop(0))
            count[b] += 1
        return set(taken)

    for total in (0, 3, 10, 29, 100):
        rows = [(rng.choice("abcd"), i) for i in range(30)]
        got = windows.water_fill(spark.createDataFrame(rows, "b string, i int"), "b", ["i"], total)
        assert {r["i"] for r in got.collect()} == filled(rows, total)
    assert windows.fair_targets({"a": 1, "b": 5, "c": 5}, 7) == {"a": 1, "b": 3, "c": 3}
    assert windows.fair_targets({"a": 9, "b": 9}, 5) == {"a": 3, "b": 2} and windows.fair_targets({}, 5) == {} and windows.fair_targets({"a": 2, "b": 0}, 9) == {"a": 2, "b": 0}
    one = spark.createDataFrame([([("a", 1), ("b", 5), ("c", 5)],)], "c array<struct<name:string,capacity:bigint>>")
    assert {r["name"]: r["quota"] for r in one.select(F.inline(windows.even_quotas(F.col("c"), F.lit(7)))).collect()} == {"a": 1, "b": 3, "c": 3}
    assert windows.quotas(10, 3) == [4, 3, 3]


def test_two_pass_and_caps(spark):
    rows = [("g", "t1", 9.0, "a"), ("g", "t1", 8.0, "b"), ("g", "t2", 1.0, "c"), ("g", "t2", None, "d")]
    got = windows.two_pass_diverse(spark.createDataFrame(rows, "g string, t string, q double, i string"), "g", "t", "q", "i", 3)
    assert [r["i"] for r in got.orderBy("position").collect()] == ["a", "c", "b"]
    capped = windows.cap_running_size(spark.createDataFrame([("b", i, 4) for i in range(5)], "b string, i int, n int"), "b", ["i"], "n", 10)
    assert [(r["i"], r["room"]) for r in capped.orderBy("i").collect()] == [(0, 4), (1, 4), (2, 2)]
    turns = windows.interleave(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, i int"), "k", ["y", "x"], ["i"])
    assert [r["i"] for r in turns.orderBy("turn", "seat").collect()] == [3, 1, 2]


def test_sequences(spark):
    e = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, None), ("u", 4, None), ("u", 5, "a")], "u string, t int, v string")
    assert [r["t"] for r in sequences.drop_consecutive(e, ["u"], ["t"], ["v"]).orderBy("t").collect()] == [1, 3, 5]
    runs = spark.createDataFrame([("u", x) for x in (1, 2, 2, 5, 6, 9)] + [("u", None)], "u string, i int")
    assert tuple(sequences.longest_island(runs, ["u"], "i").head()) == ("u", 1, 2, 2)
    arcs = sequences.arcs(spark.createDataFrame([("u", float(a)) for a in (350, 355, 5, 10, 100, 110, -5)], "u string, a double"), ["u"], "a", 25.0)
    assert [(r["start"], r["end"], r["n"]) for r in arcs.orderBy("arc").collect()] == [(100.0, 110.0, 2), (350.0, 10.0, 5)]
    m = sequences.monotonic_fraction(spark.createDataFrame([("u", i, v) for i, v in enumerate((1.0, 2.0, 2.0, 1.0, 3.0))] + [("w", 0, 1.0)], "u string, t int, v double"), ["u"], ["t"], "v")
    assert {r["u"]: r["fraction"] for r in m.collect()} == {"u": pytest.approx(2 / 3), "w": 1.0}
    b = spark.range(1).select(sequences.bounce(F.array(*[F.lit(x) for x in "ABC"]), 3).alias("b")).head()[0]
    assert "".join(b) == "ABCBABC"


def test_splits(spark, rng):
    rows = [(k, i) for k in range(25) for i in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "k int, i int")
    got = {r["k"]: r["split"] for r in splits.leak_free(df, ["k"], 20).collect()}
    sizes = sorted((sum(r[0] == k for r in rows), k) for k in range(25))
    before, expected = 0, {}
    for n, k in sizes:
        expected[k] = "eval" if before < 20 else "train"
        before += n
    assert got == expected
    o = spark.createDataFrame([(["a"],), (["a", "z"],), (["z"],), ([],)], "l array<string>")
    assert [r[0] for r in o.select(splits.ood_split(F.col("l"), ["a", "b"])).collect()] == ["eval", None, "train", None]
    assert splits.shared_keys(df.where("k < 5"), df.where("k > 3"), ["k"]).collect() == [(4,)]


def test_greedy(spark):
    rows = [("g", f"c{i}", "cw" if i < 4 else "ccw", float(9 - i)) for i in range(6)] + [("h", "z", None, None)]
    got = greedy.clips_of_group(spark.createDataFrame(rows, "g string, c string, d string, q double"), "g", "c", ["d"], "q", 3)
    assert [r["c"] for r in got.where("g = 'g'").orderBy("position").collect()] == ["c0", "c4", "c1"] and got.where("g = 'h'").count() == 1
    cand = spark.createDataFrame([(i, "s" if i < 5 else f"s{i}", "l" if i % 2 else f"l{i}") for i in range(10)], "i int, s string, l string")
    ids = greedy.balanced_under_caps(cand, "i", "s", "l", 6, 1, 1)
    assert len(ids) == len(set(ids)) == 6 and len(greedy.balanced_under_caps(cand, "i", "s", "l", 99, 1, 1)) == 10
    assert greedy.adaptive_targets({"a": 1, "b": 9, "c": 9}, 9) == {"a": 1, "b": 4, "c": 4}
    assert greedy.longest_first_shards({"a": 5, "b": 3, "c": 3, "d": 1}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert greedy.relax_until([1, 2, 3], lambda s: list(range(s)), lambda r: len(r) >= 2) == ([0, 1], 2)
    scene = spark.createDataFrame([("s", i, f"k{i % 2}", f"a{i // 2}", float(-i)) for i in range(6)], "s string, i int, k string, a string, r double")
    assert [r["i"] for r in greedy.scene_three_passes(scene, "s", "i", ["k"], "a", "r", 5).orderBy("position").collect()] == [0, 1, 2, 4, 3]
    h = spark.createDataFrame([("g", i, b, float(-i)) for i, b in enumerate([0, 1, 255, 254, 65280])], "g string, i int, b bigint, q double")
    assert [r["i"] for r in greedy.hash_distinct(h, "g", "i", "b", "q", 6, 4).orderBy("position").collect()] == [0, 2, 4, 1]
    picks = greedy.novelty_pick(spark.createDataFrame([(1, "s", ["a"], "r"), (2, "s", ["a", "b"], "r"), (3, "t", ["a"], "q")], "i int, s string, a array<string>, r string"), "i", "s", "a", "r", 3)
    assert picks == [2, 3, 1]


def test_distributions(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert [tuple(r) for r in distribution.share_table(df, "k").collect()] == [("a", 2, 66.7), ("b", 1, 33.3)]
    assert [tuple(r) for r in distribution.share_table(df, "k", total=4).collect()] == [("a", 2, 50.0), ("b", 1, 25.0)]
    bins = spark.createDataFrame([(-1.0,), (0.0,), (359.9,), (720.0,)], "a double").select(distribution.angle_bin(F.col("a")))
    assert [r[0] for r in bins.collect()] == ["330-359", "000-029", "330-359", "000-029"]
    assert distribution.share_table(df.where("false"), "k").count() == 0
