"""Dispersion dialects, roll-ups, correlations, constraints and the best constant, against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from evalloom.functions.metrics import CANDIDATE_FACTORS, MRA_THRESHOLDS
from evalloom.operators import baseline, breakdown, consistency, constraints


def cv_of(spark, values, dialect):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    return consistency.group_cv(df, ["g"], "v", dialect).head()["cv"]


@pytest.mark.parametrize(
    ("values", "dialect", "expected"),
    [
        ([0.0, 0.0, 0.0], "strict", 0.0), ([1.0, -1.0], "strict", None), ([-1.0, -3.0], "strict", None), ([1.0, None], "strict", None), ([2.0], "strict", None),
        ([0.0, 0.0, 0.0], "production", None), ([-1.0, -3.0], "production", -math.sqrt(2) / 2), ([1.0, 3.0, None], "production", math.sqrt(2) / 2),
        ([0.0, 0.0], "combined", 0.0), ([1.0, 3.0, float("inf")], "combined", math.sqrt(2) / 2), ([1.0, 3.0, float("nan")], "latex", math.sqrt(2) / 2), ([-1.0, -3.0], "latex", -math.sqrt(2) / 2),
        ([0.0, 0.0], "demo", None), ([1.0, 3.0, float("nan")], "strict", None),
    ],
)
def test_dialects(spark, values, dialect, expected):
    got = cv_of(spark, values, dialect)
    assert got == pytest.approx(expected) if expected is not None else got is None


def test_null_keys_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0), ("a", 3.0)], "cv string, v double")
    assert [r["cv"] for r in consistency.group_cv(df.withColumnRenamed("cv", "k").withColumn("rows", F.lit(1)), ["k"], "v").collect()] == [pytest.approx(math.sqrt(2) / 2)]
    empty = spark.createDataFrame([], "k string, v double")
    assert consistency.group_cv(empty, ["k"], "v").count() == 0


def test_breakdown_slices_first(spark):
    rows = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 5.0), ("b", "y", 2.0), ("b", "y", 2.0), (None, "x", 9.0)]
    df = spark.createDataFrame(rows, "g string, s string, v double")
    got = {(r["axis"], r["value"]): r for r in breakdown.score_breakdown(df, {"all": [], "s": ["s"]}, "g", "v", {"m": F.col("v")}).collect()}
    assert got["s", "y"]["n"] == 3 and got["s", "y"]["n_groups"] == 1 and got["s", "y"]["mean_cv"] == 0
    assert got["s", "x"]["n_groups"] == 1 and got["all", "all"]["n_groups"] == 2


def test_repeat_variance_and_completeness(spark):
    rows = [("q", 1, 1.0), ("q", 1, 3.0), ("q", 2, 5.0), ("q", 3, 2.0), ("q", 3, 2.0), ("q", 3, None)]
    df = spark.createDataFrame(rows, "k string, g int, v double")
    r = consistency.repeat_variance(df, ["k"], ["g"], "v").head()
    assert (r["n_repeats"], r["mean"], r["max"], r["p90"]) == (2, 0.5, 1.0, 1.0)
    c = consistency.completeness(df, ["k"], "g", F.col("v").isNotNull()).head()
    assert (c["n"], c["parse_rate"], c["n_groups"]) == (6, pytest.approx(5 / 6), 3) and c["complete_rate"] == pytest.approx(2 / 3)


def test_spearman_with_ties(spark):
    rng = random.Random(1)
    rows = [("k", float(rng.randint(0, 5)), float(rng.randint(0, 5))) for _ in range(80)] + [("k", None, 1.0)]
    got = consistency.rank_correlation(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").head()

    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    x, y = zip(*[(a, b) for _, a, b in rows if a is not None], strict=True)
    assert got["n"] == 80 and got["spearman"] == pytest.approx(statistics.correlation(ranks(x), ranks(y))) and got["pearson"] == pytest.approx(statistics.correlation(x, y))


def test_weighted_merge_ranks_and_best(spark):
    df = spark.createDataFrame([("a", "n", 2.0, 2.0), ("a", "n", 4.0, 4.0), ("a", "m", 1.0, 2.0), ("a", "m", 4.0, 4.0), ("a", "m", None, 9.0)], "k string, metric string, v double, w double")
    assert {r["metric"]: r["v"] for r in breakdown.weighted_merge(df, ["k"], "metric", "v", "w", ["n"]).collect()} == {"n": 6.0, "m": 3.0}
    r = breakdown.ranked(spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 2.0), ("n", None)], "name string, v double"), "v", "name")
    assert [(x["name"], x["rank"]) for x in r.orderBy("rank").collect()] == [("y", 1), ("z", 2), ("x", 3), ("n", 4)]


def test_constraints(spark):
    v = spark.createDataFrame([([5.0, 2.0, 2.0],), ([3.0, 2.0, 1.0],), ([None, 2.0, 1.0],)], "v array<double>")
    got = [tuple(r) for r in v.select(constraints.triangle_violation(F.col("v")), constraints.strictly_falling(F.col("v")), constraints.within(constraints.triangle_violation(F.col("v")), 0.22)).collect()]
    assert got[:2] == [(1.0, False, False), (0.0, True, True)] and got[2][0] is None
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(3)] + [("b", i, 1.0) for i in range(4)], "g string, i int, v double")
    assert [tuple(r) for r in constraints.triplets(rows, "g", "i", ["v"]).collect()] == [("a", [0.0, 1.0, 2.0])]


def test_best_constant_against_brute_force(spark):
    rng = random.Random(3)
    targets = [round(rng.uniform(0.2, 6), 1) for _ in range(200)] + [0.0, -1.0]
    df = spark.createDataFrame([("q", t) for t in targets] + [("q", None)], "k string, t double")
    got = baseline.best_constant(df, ["k"], "t").head()

    def score(c):
        return round(sum(sum(abs((c - t) / t) <= x for x in MRA_THRESHOLDS) / 10 for t in targets if t > 0) / len(targets), 9)

    candidates = sorted({t * f for t in targets if t > 0 for f in [1.0, *CANDIDATE_FACTORS, *[2 - f for f in CANDIDATE_FACTORS]]})
    best = max(candidates, key=lambda c: (score(c), -c))
    whole = baseline.best_constant(df, [], "t").head()
    assert (whole["constant"], whole["n"]) == (got["constant"], got["n"])
    assert got["constant"] == best and got["mean_mra"] == score(best) and got["n"] == len(targets)
