"""The best constant prediction: the accuracy that answering one number to every question of a type would reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.metrics import CANDIDATE_FACTORS, MRA_THRESHOLDS, relative_error

#: Places on the logarithmic scale are cut at this width; what lies closer is compared one by one.
GRAIN = 1e-8
#: Grains that are summed up together.
CELL = 200_000


def best_constant(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """(keys, constant, mean_mra, n): of all targets t, t * f and t * (2 - f) the one with the highest mean MRA; the smallest on ties.

    Targets that are null or NaN are left out. Targets that are not positive score 0 for every candidate but count in n; a key of such targets only is left out.

    A target of value t, with each threshold x, gives a point to the constants from t(1 - x) to t(1 + x). So the points of a constant are a running
    sum: the intervals that began below it less those that ended. Targets are counted by value first; beginnings, ends and candidates are placed on a
    logarithmic scale, added up by cells, and summed within a cell only, so the work grows with the number of distinct values and no key or cell
    is compared pair by pair. Beginnings and ends within a grain of a candidate are decided by the metric's own comparison.
    """
    known = df.where(F.col(target).isNotNull() & ~F.isnan(target))
    counts = known.groupBy(*keys, F.col(target).cast("double").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    positive = counts.where((F.col("_t") > 0) & (F.col("_t") < float("inf")))
    factors = F.array(F.lit(1.0), *[F.lit(f) for f in CANDIDATE_FACTORS], *[F.lit(2 - f) for f in CANDIDATE_FACTORS])
    candidates = positive.select(*keys, F.explode(F.transform(factors, lambda f: f * F.col("_t"))).alias("constant")).distinct()
    place = lambda c: F.floor(F.ln(c) / F.lit(GRAIN)).cast("long")
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(s).alias("s")) for x in MRA_THRESHOLDS for s in (1, -1)]))
    ends = positive.select(*keys, "_t", "_n", sides.alias("_e")).select(*keys, "_t", "_e.x", "_e.s", (F.col("_n") * F.col("_e.s")).alias("_w"), place(F.col("_t") * (1 - F.col("_e.s") * F.col("_e.x"))).alias("_q"))
    # What lies below a candidate by more than a grain counts whole; candidates take the place of the last such grain.
    steps = ends.groupBy(*keys, "_q").agg(F.sum("_w").alias("_w")).select(*keys, "_q", "_w", F.lit(None).cast("double").alias("constant"))
    seats = candidates.select(*keys, (place(F.col("constant")) - 2).alias("_q"), F.lit(0).cast("long").alias("_w"), "constant")
    line = steps.unionByName(seats).withColumn("_cell", F.floor(F.col("_q") / CELL))
    cells = line.groupBy(*keys, "_cell").agg(F.sum("_w").alias("_s"))
    cells = cells.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_cell")) - F.col("_s")).drop("_s")
    within = F.sum("_w").over(Window.partitionBy(*keys, "_cell").orderBy("_q").rangeBetween(Window.unboundedPreceding, 0))
    clear = line.withColumn("_in", within).where(F.col("constant").isNotNull()).join(cells, [*keys, "_cell"]).select(*keys, "constant", (F.col("_in") + F.col("_before")).alias("_points"))
    around = candidates.withColumn("_q", F.explode(F.sequence(place(F.col("constant")) - 1, place(F.col("constant")) + 1)))
    passes = relative_error(F.col("constant"), F.col("_t")) <= F.col("x")
    # A beginning so near counts if the candidate passes; an end so near is not counted above, and must be if it does not.
    extra = F.when(passes & (F.col("s") > 0), F.col("_w")).when(~passes & (F.col("s") < 0), F.col("_w")).otherwise(0)
    close = around.join(ends, [*keys, "_q"]).select(*keys, "constant", extra.alias("_points"))
    sums = clear.unionByName(close).groupBy(*keys, "constant").agg((F.sum("_points") / 10.0).alias("_s"))
    scored = sums.join(totals, keys) if keys else sums.withColumn("n", totals.scalar())
    scored = scored.withColumn("mean_mra", F.round(F.col("_s") / F.col("n"), 9))
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("mean_mra")).alias("m"), "constant", "n")).alias("_b"))
    return best.where(F.col("_b").isNotNull()).select(*keys, F.col("_b.constant").alias("constant"), (-F.col("_b.m")).alias("mean_mra"), F.col("_b.n").alias("n"))
