"""Row metrics: threshold-averaged relative accuracy (MRA) and clipped absolute percentage error (CAPE)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 1 - linspace(0.5, 0.95, 10) in binary floating point. A computed 1 - (0.5 + 0.05 i) differs in the last bit and
# would flip errors of exactly 10 or 15 percent.
MRA_THRESHOLDS = [0.5, 0.44999999999999996, 0.4, 0.35, 0.30000000000000004, 0.25, 0.19999999999999996, 0.15000000000000002, 0.10000000000000009, 0.050000000000000044]
# arange(0.5, 0.96, 0.05), the multipliers of the best-constant search.
CANDIDATE_FACTORS = [0.5, 0.55, 0.6000000000000001, 0.6500000000000001, 0.7000000000000002, 0.7500000000000002, 0.8000000000000003, 0.8500000000000003, 0.9000000000000004, 0.9500000000000004]

#: What a row counts for when its prediction cannot be parsed.
WORST = {"mra": 0.0, "cape": 1.0}


def relative_error(pred: Column, target: Column) -> Column:
    """|pred - target| / target; for target 0 it is 0 if pred is 0 and infinite otherwise. Null if either is null."""
    p, t = pred.cast("double"), target.cast("double")
    return F.when(t == 0, F.when(p == 0, F.lit(0.0)).when(p.isNotNull(), F.lit(float("inf")))).otherwise(F.abs(F.try_divide(p - t, t)))


def mra(pred: Column, target: Column) -> Column:
    """Share of the ten thresholds that the relative error does not exceed. Unrolled to ten comparisons, so it stays in generated code."""
    e = relative_error(pred, target)
    passed = sum(((e <= F.lit(x)).cast("int") for x in MRA_THRESHOLDS[1:]), (e <= F.lit(MRA_THRESHOLDS[0])).cast("int"))
    return passed / F.lit(10.0)


def cape(pred: Column, target: Column) -> Column:
    """min(1, |pred - target| / |target|). A target of 0 is the worst case, even for a prediction of 0; null if either is null."""
    p, t = pred.cast("double"), target.cast("double")
    return F.when(t == 0, F.when(p.isNotNull(), F.lit(WORST["cape"]))).otherwise(F.least(F.lit(1.0), F.abs(F.try_divide(p - t, t))))


def cape_list(pred: Column, target: Column) -> Column:
    """Mean CAPE of two arrays of one length; a target of 0 counts 1 there. Null for different lengths or a null element."""
    pairs = F.zip_with(pred, target, lambda p, t: F.when(p.isNull() | t.isNull(), None).when(t == 0, 1.0).otherwise(F.least(F.lit(1.0), F.abs(F.try_divide(p - t, t)))))
    bad = (F.size(pred) != F.size(target)) | (F.size(pred) == 0) | F.exists(pairs, lambda x: x.isNull())
    return F.when(~bad, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.size(pred))


METRICS = {"mra": mra, "cape": cape}


def scored(name: str, pred: Column, target: Column) -> Column:
    """A metric by name, with its worst value where the prediction or target could not be parsed, so that the row still counts."""
    return F.coalesce(METRICS[name](pred, target), F.lit(WORST[name]))


def first_true_value(value: Column, fallback: Column) -> Column:
    """``value`` unless it is null, 0 or empty; then ``fallback``. Both are text or castable to it."""
    text = value.cast("string")
    return F.when(text.isNull() | (text == "") | (F.coalesce(text.try_cast("double"), F.lit(1.0)) == 0), fallback).otherwise(value)


def error_band(error: Column, good: float = 0.25, fair: float = 0.5) -> Column:
    """'good', 'fair' or 'poor' by error; 'none' for null."""
    return F.when(error.isNull(), "none").when(error <= good, "good").when(error <= fair, "fair").otherwise("poor")
