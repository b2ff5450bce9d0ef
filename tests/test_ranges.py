"""Operators that do not sort or compare a hot key in one task, against plain Python: running totals, fills, nearest points, best constants."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evalloom.functions.metrics import CANDIDATE_FACTORS, MRA_THRESHOLDS
from evalloom.operators import baseline, consistency, joins, splits, windows


@pytest.mark.parametrize("hot", [10, 10**6])
def test_running_totals(spark, hot):
    rng = random.Random(hot)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(1, 5), rng.choice([i % 40, None]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, n int, o int, i int").repartition(5)
    got = {r["i"]: r["t"] for r in windows.running_total(df, ["k"], [F.desc_nulls_last("o"), F.col("i")], F.col("n"), "t", hot).collect()}
    run, want = Counter(), {}
    for k, n, _, i in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[3])):
        run[k] += n
        want[i] = run[k]
    assert got == want
    assert windows.running_total(df.where("false"), ["k"], ["i"], F.col("n"), "t", hot).count() == 0


@pytest.mark.parametrize("hot", [10, 10**6])
def test_caps_and_turns_of_hot_keys(spark, hot):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b"]), rng.randint(1, 9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, n int, i int").repartition(4)
    got = {r["i"]: r["room"] for r in windows.cap_running_size(df, "k", ["i"], "n", 100, hot).collect()}
    before, want = Counter(), {}
    for k, n, i in rows:
        if before[k] < 100:
            want[i] = min(n, 100 - before[k])
        before[k] += n
    assert got == want
    turns, want = Counter(), {}
    for k, _, i in rows:
        turns[k] += 1
        want[i] = (turns[k], ["a", "hot"].index(k) if k in ("a", "hot") else 2)
    assert {r["i"]: (r["turn"], r["seat"]) for r in windows.interleave(df, "k", ["a", "hot"], ["i"], hot).collect()} == want


def test_ranks_and_splits_by_ranges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["h", "h", "g"]), float(rng.randint(0, 60)), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    keys = spark.createDataFrame([(rng.randint(0, 150),) for _ in range(260)], "k int")
    plain = {r["k"]: r["spearman"] for r in consistency.rank_correlation(df, ["k"], "x", "y").collect()}
    split = sorted(map(tuple, splits.leak_free(keys, ["k"], 70).collect()))
    monkeypatch.setattr(windows.running_total, "__defaults__", (15,))
    ranged = {r["k"]: r["spearman"] for r in consistency.rank_correlation(df, ["k"], "x", "y").collect()}
    assert ranged == pytest.approx(plain) and sorted(map(tuple, splits.leak_free(keys, ["k"], 70).collect())) == split


def test_water_fill_of_any_buckets(spark):
    rng = random.Random(6)
    for total in (0, 1, 7, 40, 500):
        rows = [(f"b{int(rng.random() ** 3 * 30):02d}", i) for i in range(200)] + [(None, 900)]
        df = spark.createDataFrame(rows, "b string, i int")
        by = defaultdict(list)
        for b, i in rows:
            if b is not None:
                by[b].append(i)
        want = sorted((n + 1, b, i) for b, ids in by.items() for n, i in enumerate(ids))[:total]
        assert sorted((r["level"], r["b"], r["i"]) for r in windows.water_fill(df, "b", ["i"], total).collect()) == want


def test_hierarchical_fill(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaaaab"), rng.choice(["s", "s", "s", "t", None]), rng.choice("xy"), i) for i in range(150)] + [(None, "s", "x", 1000), ("c", "s", "x", 1001), ("c", "t", "x", 1002)]
    df = spark.createDataFrame(rows, "o string, s string, m string, i int")
    for total in (0, 5, 30, 1000):
        got = windows.hierarchical_fill(df, ["o", "s", "m"], ["i"], total).collect()
        have, count = Counter(r[0] for r in rows), Counter(r["o"] for r in got)
        left, want = total, {}
        for n, o in enumerate(sorted(have, key=lambda o: (have[o], o is not None, o or ""))):
            want[o] = min(have[o], left // (len(have) - n))
            left -= want[o]
        assert count == Counter({k: v for k, v in want.items() if v})
        for o in count:  # scenes of an object alternate as long as they last
            scenes, there = Counter(r["s"] for r in got if r["o"] == o), Counter(r[1] for r in rows if r[0] == o)
            assert all(scenes[s] >= min(there[s], max(scenes.values()) - 1) for s in there)


def test_nearest_in_plane_of_far_and_crowded_points(spark):
    rng = random.Random(8)
    points = [(i, 1000 + rng.gauss(0, 1), 1000 + rng.gauss(0, 1)) for i in range(150)] + [(200 + i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(40)] + [(300, 5.0, 5.0), (301, 5.0, 5.0), (302, 7.0, 5.0), (303, None, 1.0)]
    probes = [(i, rng.uniform(-2000, 3000), rng.uniform(-2000, 3000)) for i in range(40)] + [(50 + i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(40)] + [(98, 6.0, 5.0), (99, 5.0, 5.0), (97, float("nan"), 1.0), (96, None, 0.0)]
    p, q = spark.createDataFrame(probes, "p int, x double, y double"), spark.createDataFrame(points, "q int, x double, y double")
    got = {r["p"]: (r["q"], r["distance"]) for r in joins.nearest_in_plane(p, "p", q, "q", ["x", "y"], 0.5).collect()}
    fine = [t for t in points if t[1] is not None]
    want = {i: min((math.sqrt((a - x) ** 2 + (b - y) ** 2), k) for k, a, b in fine) for i, x, y in probes if x is not None and not math.isnan(x)}
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and all(got[k][1] == pytest.approx(want[k][0]) for k in want)
    assert joins.nearest_in_plane(p, "p", q.where("false"), "q", ["x", "y"], 0.5).count() == 0 and joins.nearest_in_plane(p.where("false"), "p", q, "q", ["x", "y"], 0.5).count() == 0


def test_best_constant_by_running_sums(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice([round(rng.uniform(0.1, 5), 1), round(rng.uniform(0.1, 5), 3), 1.0, 0.5, 2.0])) for _ in range(300)] + [("a", None), ("a", float("nan")), ("a", 0.0), ("b", -2.0), ("c", 0.0), ("d", None)]
    got = {r["k"]: (r["constant"], r["mean_mra"], r["n"]) for r in baseline.best_constant(spark.createDataFrame(rows, "k string, t double"), ["k"], "t").collect()}
    assert set(got) == {"a", "b"}
    factors = [1.0, *CANDIDATE_FACTORS, *[2 - f for f in CANDIDATE_FACTORS]]
    for k in "ab":
        values = [t for x, t in rows if x == k and t is not None and not math.isnan(t)]
        score = lambda c: round(sum(sum(abs((c - t) / t) <= x for x in MRA_THRESHOLDS) / 10 for t in values if t > 0) / len(values), 9)  # noqa: B023, E731
        best = min((-score(f * t), f * t) for t in set(values) if t > 0 for f in factors)
        assert got[k] == (best[1], pytest.approx(-best[0]), len(values))
