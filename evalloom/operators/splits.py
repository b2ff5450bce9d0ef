"""Train and evaluation splits without leaks, and out-of-distribution splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.windows import running_total


def leak_free(df: DataFrame, key: list[str], need: int, train_need: int = 0) -> DataFrame:
    """(key, n, split): whole keys go to evaluation, smallest first (ties by key), as long as the records before them are fewer than ``need``.
    If train is then short of ``train_need``, keys go back to it, smallest first, while evaluation keeps ``need``; raises if that does not suffice.

    Running totals come from counts per (size), then per key inside the one size where the need is met; a size class of very many keys is ranked by ranges.
    """
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    classes = sizes.groupBy("n").agg((F.count(F.lit(1)) * F.col("n")).alias("_all"))
    classes = classes.select("n", (F.sum("_all").over(Window.orderBy("n")) - F.col("_all")).alias("_before"))
    joined = sizes.join(F.broadcast(classes), "n")  # one row a distinct size
    first = joined.where(F.col("_before") < need)
    # Within a size class every key adds the same, so the position of a key in its class gives its running total.
    ranked = running_total(first, ["n"], list(key), F.lit(1), "_r")
    chosen = ranked.withColumn("_run", F.col("_before") + (F.col("_r") - 1) * F.col("n")).where(F.col("_run") < need)
    if train_need > 0:
        total = sizes.agg(F.sum("n")).head()[0] or 0
        held = chosen.agg(F.sum("n")).head()[0] or 0
        short = train_need - (total - held)
        if short > 0:
            # Evaluation is a prefix by size, and so is what goes back: its running totals are the same.
            back = (F.col("_run") < short) & (F.col("_run") + F.col("n") <= held - need)
            if (chosen.where(back).agg(F.sum("n")).head()[0] or 0) < short:
                raise ValueError(f"no split of whole keys found with {need} records for evaluation and {train_need} for training")
            chosen = chosen.where(~back)
    chosen = chosen.select(*key, F.lit("eval").alias("split"))
    return sizes.join(chosen, key, "left").select(*key, "n", F.coalesce("split", F.lit("train")).alias("split"))


def ood_split(labels: Column, known: list[str]) -> Column:
    """'eval' if all labels are known ones, 'train' if none is, null (dropped) if mixed or empty."""
    allow = F.array(*[F.lit(x) for x in known])
    return F.when(F.size(labels) == 0, None).when(F.size(F.array_except(labels, allow)) == 0, "eval").when(~F.arrays_overlap(labels, allow), "train")


def varied_keys(df: DataFrame, key: list[str], answer: Column, least: int = 2) -> DataFrame:
    """Rows of the keys with at least ``least`` distinct answers; the other keys are degenerate. Distinct pairs are combined before they are counted."""
    pairs = df.select(*key, answer.alias("_a")).where(F.col("_a").isNotNull()).distinct()
    good = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*key)
    return df.join(good, key, "left_semi")


def shared_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys in both: empty for splits without a leak."""
    return a.select(*key).intersect(b.select(*key))
