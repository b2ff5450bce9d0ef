"""Metrics by many axes at once, roll-ups of summaries, pivots, ranks and flags of the best."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.consistency import DIALECTS, cv_from, usable


def by_axis(df: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """Rows once an axis, as (axis, value, ...): value is the columns of the axis joined by '_x_', 'all' for none. Rows with a null in it are
    left out of that axis. The explode is before the first shuffle, so one shuffle serves all axes."""
    tags = [F.struct(F.lit(name).alias("axis"), (F.concat_ws("_x_", *cols) if cols else F.lit("all")).alias("value"), reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True)).alias("ok")) for name, cols in axes.items()]
    return df.withColumn("_a", F.explode(F.array(*tags))).where("_a.ok").select(F.col("_a.axis").alias("axis"), F.col("_a.value").alias("value"), *df.columns)


def score_breakdown(df: DataFrame, axes: dict[str, list[str]], group: str, value: str, metrics: dict[str, Column], dialect: str = "strict") -> DataFrame:
    """(axis, value, n, <metrics>, n_groups, mean_cv): means of row metrics and mean group dispersion per slice.

    Rows are sliced first and grouped second, so a group that spans two slices counts in each with its own rows. Rows with a null group count
    in n and the metrics only. Rows are first added up per (all axis columns, group), so what is multiplied by the axes and shuffled is
    cells rather than rows; cells are merged per (axis, value, group) and groups per (axis, value). No join, each step combined on
    the map side. Deviations of merged cells come from counts, means and squared deviations.
    """
    d = DIALECTS[dialect]
    columns = sorted({c for cols in axes.values() for c in cols})
    used = usable(F.col("_v"), d)
    base = df.select(*columns, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"), *[m.alias(f"_m_{k}") for k, m in metrics.items()])
    cells = base.groupBy(*columns, "_g").agg(
        F.count(F.lit(1)).alias("_n"), F.count(used).alias("_k"), F.avg(used).alias("_mean"), F.var_pop(used).alias("_var"), F.min(used).alias("_lo"), F.max(used).alias("_hi"),
        *[F.sum(f"_m_{k}").alias(f"_s_{k}") for k in metrics], *[F.count(f"_m_{k}").alias(f"_c_{k}") for k in metrics],
    )
    sums = [f"_{x}_{k}" for k in metrics for x in "sc"]
    k, mean = F.col("_k"), F.col("_mean")
    groups = by_axis(cells, axes).groupBy("axis", "value", "_g").agg(
        F.sum("_n").alias("_n"), F.sum("_k").alias("_k"), F.sum(k * mean).alias("_sum"), F.sum(k * F.col("_var")).alias("_in"), F.sum(k * mean * mean).alias("_sq"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.sum(x).alias(x) for x in sums],
    )
    average = F.try_divide(F.col("_sum"), F.col("_k"))
    spread = F.col("_in") + F.greatest(F.lit(0.0), F.col("_sq") - F.col("_sum") * average)
    std = F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(F.sqrt(F.try_divide(spread, F.col("_k") - 1)))
    cv = F.when(F.col("_g").isNotNull(), cv_from(d, F.col("_n"), F.col("_k"), average, std, F.col("_lo"), F.col("_hi")))
    means = [F.try_divide(F.sum(f"_s_{k}"), F.sum(f"_c_{k}")).alias(k) for k in metrics]
    return groups.withColumn("_cv", cv).groupBy("axis", "value").agg(F.sum("_n").alias("n"), *means, F.count("_cv").alias("n_groups"), F.avg("_cv").alias("mean_cv"))


def roll_up(df: DataFrame, pattern: Column, groups: dict[str, list[str]], group: str, pred: str, metric: Column, dialect: str = "latex") -> DataFrame:
    """(variation, n, metric, n_groups, mean_cv): rows pooled by the larger variation that their pattern belongs to, so that patterns weigh by their rows: the mean metric in percent over the
    rows that have one, and the mean dispersion over their groups. Patterns of no variation are left out."""
    names = F.lit(None).cast("string")
    for name, patterns in groups.items():
        names = F.when(pattern.isin(*patterns), name).otherwise(names)
    rows = df.withColumn("variation", names).where(F.col("variation").isNotNull())
    out = score_breakdown(rows, {"variation": ["variation"]}, group, pred, {"metric": metric}, dialect)
    return out.select(F.col("value").alias("variation"), "n", (F.col("metric") * 100).alias("metric"), "n_groups", "mean_cv")


def extremes(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys, easiest, highest, hardest, lowest): the name of the highest and of the lowest value of each key, ties to the first name; null values are left out."""
    known = df.where(F.col(value).isNotNull())
    best = known.groupBy(*keys).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n"))).alias("_h"), F.min(F.struct(F.col(value).alias("v"), F.col(name).alias("n"))).alias("_l"))
    return best.select(*keys, F.col("_h.n").alias("easiest"), (-F.col("_h.v")).alias("highest"), F.col("_l.n").alias("hardest"), F.col("_l.v").alias("lowest"))


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metric columns as rows (keys, metric, v); null values are dropped."""
    out = df.unpivot(keys, metrics, "metric", "v")
    return out.where(F.col("v").isNotNull())


def flat_metric_parts(key: Column) -> Column:
    """The parts (axis, value, metric) of a flat metric key such as 'qtype:size_mean_CV' or 'overall_n'. Fixed pattern."""
    p = r"^(overall|(?:qtype|qfamily|etype|engine|motion):(.+))_(n_groups|mean_CV|MRA|CAPE|n)$"
    head = F.regexp_extract(key, p, 1)
    return F.when(head != "", F.struct(F.substring_index(head, ":", 1).alias("axis"), F.regexp_extract(key, p, 2).alias("value"), F.regexp_extract(key, p, 3).alias("metric")))


def weighted_merge(df: DataFrame, keys: list[str], metric: str, value: str, weight: str, counts: list[str]) -> DataFrame:
    """(keys, metric, v): weighted mean over the merged summaries; metrics in ``counts`` are summed. A total weight of 0 gives null."""
    v = F.col(value)
    used = F.when(v.isNotNull(), F.col(weight))
    sums = df.groupBy(*keys, metric).agg(F.sum(v).alias("_sum"), F.try_divide(F.sum(v * used), F.sum(used)).alias("_mean"))
    return sums.select(*keys, metric, F.when(F.col(metric).isin(*counts), F.col("_sum")).otherwise(F.col("_mean")).alias("v"))


def pivot_table(df: DataFrame, rows: list[str], column: str, values: list, agg: Column, fill=None) -> DataFrame:
    """Crosstab with one column a listed value; cells without rows are ``fill``. The values are given, so no extra job looks for them."""
    out = df.groupBy(*rows).pivot(column, values).agg(agg)
    return out if fill is None else out.fillna(fill, [str(v) for v in values])


def ranked(df: DataFrame, value: str, name: str, within: list[str] | None = None, descending: bool = True) -> DataFrame:
    """1-based ``rank`` by value, ties in name order, nulls last. ``within``: columns that separate rankings. For summaries (few rows a ranking)."""
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(order, name)))


def best_flags(df: DataFrame, column: str, value: str, higher: Column) -> DataFrame:
    """Adds ``best``: whether the value is the largest (where ``higher``) or smallest of its column; nulls never are."""
    w = Window.partitionBy(column)
    target = F.when(higher, F.max(value).over(w)).otherwise(F.min(value).over(w))
    return df.withColumn("best", F.coalesce(F.col(value) == target, F.lit(False)))


def row_average(cells: list[str]) -> tuple[Column, Column]:
    """Mean over the cells that are there (null if none), and whether some are missing."""
    present = F.filter(F.array(*[F.col(c).cast("double") for c in cells]), lambda x: x.isNotNull())
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    return mean, F.size(present) < len(cells)


def preferred_order(label: Column, order: list[str]) -> Column:
    """Position of a label in a preferred order; 999 for others."""
    out = F.lit(999)
    for i, x in reversed(list(enumerate(order))):
        out = F.when(label == x, F.lit(i)).otherwise(out)
    return out


def scaled_means(df: DataFrame, keys: list[str], metrics: list[str], plain: list[str], skip: Column | None = None) -> DataFrame:
    """(keys, n, metrics): means times 100, but for the ``plain`` ones. Rows for which ``skip`` holds are left out."""
    rows = df if skip is None else df.where(~F.coalesce(skip, F.lit(False)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[(F.avg(m) * (1 if m in plain else 100)).alias(m) for m in metrics])
