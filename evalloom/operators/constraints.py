"""Higher-order constraints over three related answers: triangles, ordered triplets and choice transitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILONS = (0.11, 0.22)


def triplets(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """(group, <column> array of three): the rows of each group in order, for groups of exactly three rows.

    At most four rows of a group are ever gathered: a fourth only shows that there are too many.
    """
    at = F.row_number().over(Window.partitionBy(group).orderBy(order))
    few = df.select(group, order, *columns).withColumn("_i", at).where(F.col("_i") <= 4)
    out = few.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", *columns))).alias("_r")).where(F.size("_r") == 3)
    return out.select(group, *[F.col("_r").getField(c).alias(c) for c in columns])


def triangle_violation(v: Column) -> Column:
    """By how much the longest of three distances exceeds the sum of the others; 0 if it does not. Null if one is null."""
    a, b, c = v[0], v[1], v[2]
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.greatest(F.lit(0.0), a - b - c, b - a - c, c - a - b))


def camera_triangle_violation(a: Column, b: Column, between: Column) -> Column:
    """For two distances to a camera and the distance between the objects: max(0, |a - b| - between, between - a - b)."""
    return F.when(a.isNotNull() & b.isNotNull() & between.isNotNull(), F.greatest(F.lit(0.0), F.abs(a - b) - between, between - a - b))


def scale_of(v: Column) -> Column:
    """Largest absolute value of the three, at least 1e-9: what violations are measured against. Null if one is null."""
    return F.when(~F.exists(v, lambda x: x.isNull()), F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(1e-9)))


def within(violation: Column, eps: float) -> Column:
    return violation <= F.lit(eps)


def strictly_falling(v: Column) -> Column:
    return (v[0] > v[1]) & (v[1] > v[2])


def weakly_falling(v: Column) -> Column:
    return (v[0] >= v[1]) & (v[1] >= v[2])


def transitive_choices(pred: Column, truth: Column) -> Column:
    """All three choices right; null unless every prediction is A or B."""
    valid = F.forall(pred, lambda x: x.isin("A", "B"))
    return F.when(valid, F.forall(F.zip_with(pred, truth, lambda p, t: p == t), lambda x: x))


def constraint_report(df: DataFrame, keys: list[str], violation: str) -> DataFrame:
    """(keys, n, mean_violation, p95_violation, pass rates per epsilon); the percentile is interpolated linearly."""
    rates = [F.avg((F.col(violation) <= e).cast("double")).alias(f"pass_{str(e).replace('.', 'p')}") for e in EPSILONS]
    return df.where(F.col(violation).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(violation).alias("mean_violation"), F.percentile(violation, 0.95).alias("p95_violation"), *rates)
