"""Hand-computed cases of metrics and answer parsing, and the same by brute force in Python."""

import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions import metrics, parse

THRESHOLDS = [1 - (0.5 + 0.45 * i / 9) for i in range(10)]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()[0]


def lit(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize(
    ("p", "t", "mra", "cape"),
    [(1.1, 1.0, 0.9, 0.10000000000000009), (0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 0.0, 1.0), (2.0, 2.0, 1.0, 0.0), (None, 2.0, 0.0, 1.0), (5.0, None, 0.0, 1.0), (9.0, 1.0, 0.0, 1.0)],
)
def test_metric_edges(spark, p, t, mra, cape):
    assert one(spark, metrics.scored("mra", lit(p), lit(t))) == pytest.approx(mra)
    assert one(spark, metrics.scored("cape", lit(p), lit(t))) == pytest.approx(cape)


def test_mra_against_brute_force(spark):
    rows = [(i / 7 - 3, j / 5 + 0.1) for i in range(60) for j in range(12)]
    got = spark.createDataFrame(rows, "p double, t double").select("p", "t", metrics.mra(F.col("p"), F.col("t")).alias("m")).collect()
    for r in got:
        assert r["m"] == sum(abs(r["p"] - r["t"]) / r["t"] <= x for x in metrics.MRA_THRESHOLDS) / 10


def test_cape_list_and_fallback(spark):
    assert one(spark, metrics.cape_list(F.array(lit(1.0), lit(3.0)), F.array(lit(1.0), lit(2.0)))) == 0.25
    assert one(spark, metrics.cape_list(F.array(lit(1.0), lit(3.0)), F.array(lit(0.0), lit(3.0)))) == 0.5
    assert one(spark, metrics.cape_list(F.array(lit(1.0)), F.array(lit(1.0), lit(2.0)))) is None
    assert [one(spark, metrics.first_true_value(F.lit(v), F.lit("f"))) for v in ("0", "", "1.5", "x", None)] == ["f", "f", "1.5", "x", "f"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("reasoning 3\n{'answer': 1.5}", 1.5), ("about 2 m, maybe 2.5 m", 2.5), ("no idea", None), ("", None), ("   ", None), (None, None), ("Answer: 7.", 7.0), ("x {{'answer': 4}} y", 4.0),
        ("x {'answer': '2.0'} or {'ANSWER' : 3} tail", 3.0), ("5 then True\nTrue", 1.0), ("1_000", 0.0), ("-3e2", -300.0), (".5", 0.5), ("answer = 12\r\n\r\n", 12.0), ("7 8 9.", 9.0),
    ],
)
def test_numeric_answer(spark, text, value):
    got = one(spark, parse.numeric_answer(F.lit(text).cast("string")))
    assert got == value


def test_other_answers(spark):
    choice = lambda s: one(spark, parse.choice_answer(F.lit(s).cast("string")))
    assert [choice(s) for s in ("a", "Answer: b", "It is a thing", "The B one.\n{'answer': 'A'}", "none", None, "")] == ["A", "B", "A", "A", None, None, None]
    triple = lambda s: one(spark, parse.triplet_answer(F.lit(s).cast("string")))
    assert triple("[0.4, 0.3, 0.1]") == [0.4, 0.3, 0.1]
    assert triple("say {'answer': (1, 2, 3)} ok") == [1, 2, 3]
    assert triple("L 1 W 2 H 3.5") == [1, 2, 3.5]
    assert triple("1 and 2") is None and triple(None) is None and triple("[1, 2]") is None
    first = lambda s: one(spark, parse.first_numeric_answer(F.lit(s).cast("string")))
    assert first("answer: 1.26 then answer: 9") == 1.3 and first("it is 4.44") == 4.4 and first("none") is None


def test_guarded_cast(spark):
    got = [one(spark, parse.to_float(F.lit(s).cast("string"))) for s in ("1.5f", "2d", "1_000", " 3 ", "4.", ".5", "-1e3", "", None, "abc")]
    assert got == [None, None, None, 3.0, 4.0, 0.5, -1000.0, None, None, None]
    assert math.isnan(one(spark, parse.to_float(F.lit("nan")))) and one(spark, parse.to_float(F.lit("inf"), finite=True)) is None
    assert one(spark, parse.finite_or_null(F.lit(float("inf")))) is None


def test_very_long_text(spark):
    text = "word 1.25 " * 20_000 + "\n{'answer': 3}"
    assert spark.createDataFrame([(text,)], "t string").select(parse.numeric_answer(F.col("t"))).head()[0] == 3.0
