"""Dispersion inside groups of related answers: coefficient-of-variation dialects, repeat-answer variance and roll-ups."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.windows import running_total
from evalloom.session import ship_package


@dataclass(frozen=True)
class Dialect:
    """How a coefficient of variation treats the edges.

    zero_const: a group of zeros has 0 rather than null. allow_negative: a negative mean gives a negative value rather than null.
    drop_incomplete: a group with an unparsed (null or NaN) value is left out, rather than only the value. finite_only: infinities are left out.
    """

    zero_const: bool
    allow_negative: bool
    drop_incomplete: bool
    finite_only: bool


DIALECTS = {
    "strict": Dialect(zero_const=True, allow_negative=False, drop_incomplete=True, finite_only=False),
    "production": Dialect(zero_const=False, allow_negative=True, drop_incomplete=False, finite_only=False),
    "combined": Dialect(zero_const=True, allow_negative=False, drop_incomplete=False, finite_only=True),
    "latex": Dialect(zero_const=False, allow_negative=True, drop_incomplete=False, finite_only=True),
    "demo": Dialect(zero_const=False, allow_negative=True, drop_incomplete=False, finite_only=False),
}


def usable(value: Column, d: Dialect) -> Column:
    """The value where it counts under the dialect, else null."""
    v = value.cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    return F.when(ok & (F.abs(v) < F.lit(float("inf"))) if d.finite_only else ok, v)


def cv_from(d: Dialect, rows: Column, parsed: Column, mean: Column, std: Column, low: Column, high: Column) -> Column:
    """The coefficient of variation of a group from its counts and moments."""
    constant = F.lit(0.0) if d.zero_const else F.lit(None).cast("double")
    cv = F.when((low == 0) & (high == 0), constant).when(mean == 0, None)
    cv = cv.otherwise(std / mean) if d.allow_negative else cv.when(mean > 0, std / mean)
    enough = parsed >= 2
    return F.when(enough & (parsed == rows) if d.drop_incomplete else enough, cv)


def group_cv(df: DataFrame, keys: list[str], value: str, dialect: str = "strict") -> DataFrame:
    """(keys, rows, parsed, cv): sample deviation over mean of each group, null where the dialect gives none or fewer than two values count.

    One aggregation with map-side combine; null keys form no group. NaN values count as unparsed.
    """
    d = DIALECTS[dialect]
    used = usable(F.col(value), d)
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    stats = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count(used).alias("parsed"), F.avg(used).alias("_mean"), F.stddev_samp(used).alias("_std"), F.min(used).alias("_lo"), F.max(used).alias("_hi"))
    cv = cv_from(d, *[F.col(c) for c in ("rows", "parsed", "_mean", "_std", "_lo", "_hi")])
    return stats.select(*keys, "rows", "parsed", cv.alias("cv"))


def mean_group_cv(groups: DataFrame, axes: list[str]) -> DataFrame:
    """(axes, n_groups, mean_cv, consistency): level two, over the groups with a value; consistency is 1 - exp(-mean cv)."""
    out = groups.groupBy(*axes).agg(F.count("cv").alias("n_groups"), F.avg("cv").alias("mean_cv"))
    return out.withColumn("consistency", 1 - F.exp(-F.col("mean_cv")))


def completeness(df: DataFrame, keys: list[str], group: str, ok: Column) -> DataFrame:
    """(keys, n, parse_rate, n_groups, complete_rate): share of parsed rows and of groups all of whose rows are parsed."""
    each = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("good"))
    out = each.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("good") / F.sum("n")).alias("parse_rate"), F.count(F.lit(1)).alias("n_groups"), F.avg((F.col("n") == F.col("good")).cast("double")).alias("complete_rate"))
    return out


def repeat_variance(df: DataFrame, keys: list[str], repeat: list[str], value: str) -> DataFrame:
    """(keys, n_repeats, mean, median, max, p90): population variance of each repeated question, summed up per key; p90 by nearest rank."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, *repeat).agg(F.count(F.lit(1)).alias("n"), F.var_pop(value).alias("variance")).where("n >= 2")
    v = F.col("variance")
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_repeats"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("max"), F.expr("percentile_disc(0.9) within group (order by variance)").alias("p90"))


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, pearson, spearman): Spearman's is Pearson's over average ranks. Rows with a null are left out.

    Ranks come from running counts of equal values, by ranges where a key has very many; the rows themselves are only counted.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = both
    for c in ("_x", "_y"):
        counts = both.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        counts = running_total(counts, keys, [c], F.col("_n"), "_upto")
        ranks = counts.select(*keys, c, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(f"_r{c}"))
        ranked = ranked.join(ranks, [*keys, c])
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("pearson"), F.corr("_r_x", "_r_y").alias("spearman"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def correlation_p_value(r: float | None, n: int | None) -> float | None:
    """Two-sided p-value of a correlation of ``n`` pairs: that of t = r sqrt((n - 2) / (1 - r r)) with n - 2 degrees of freedom. Null for n < 3."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def with_p_values(df: DataFrame, n: str, correlations: list[str]) -> DataFrame:
    """Adds p_<c> for correlation columns of a summary, in Arrow batches."""
    ship_package(df.sparkSession)

    @F.pandas_udf("double")
    def p_value(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([correlation_p_value(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, k, strict=True)], dtype="float64")

    return df.withColumns({f"p_{c}": p_value(F.col(c), F.col(n)) for c in correlations})
