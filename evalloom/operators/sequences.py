"""Ordered sequences: consecutive duplicates, runs, arcs, monotony and bounces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_consecutive(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows that differ in ``columns`` from the row before them in their sequence; null equals null."""
    w = Window.partitionBy(*key).orderBy(*order)
    now = F.struct(*columns)
    return df.withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", now.eqNullSafe(F.lag(now).over(w))).where(F.col("_first") | ~F.col("_same")).drop("_first", "_same")


def islands(df: DataFrame, key: list[str], place: str) -> DataFrame:
    """(key, start, end, length): runs of successive integers in ``place`` (repeats count once)."""
    w = Window.partitionBy(*key).orderBy(place)
    runs = df.select(*key, place).where(F.col(place).isNotNull()).distinct().withColumn("_i", F.col(place) - F.row_number().over(w))
    return runs.groupBy(*key, "_i").agg(F.min(place).alias("start"), F.max(place).alias("end"), F.count(F.lit(1)).alias("length")).drop("_i")


def longest_island(df: DataFrame, key: list[str], place: str) -> DataFrame:
    """The longest run of each key; the first of equally long ones."""
    runs = islands(df, key, place)
    return runs.groupBy(*key).agg(F.max_by(F.struct("start", "end", "length"), F.struct("length", -F.col("start"))).alias("r")).select(*key, "r.*")


def arcs(df: DataFrame, key: list[str], angle: str, gap: float) -> DataFrame:
    """(key, arc, start, end, n): angles in degrees cut where neighbours are more than ``gap`` apart; the last arc joins the first across 360.

    A joined arc starts before 360 and ends after 0, so its end is less than its start. Arcs are numbered from 1 by their start.
    """
    base = df.where(F.col(angle).isNotNull()).select(*key, F.pmod(F.col(angle), F.lit(360.0)).alias("_a"))
    w = Window.partitionBy(*key).orderBy("_a")
    cut = (F.col("_a") - F.lag("_a").over(w)) > gap
    parts = base.withColumn("_p", F.sum(F.coalesce(cut.cast("int"), F.lit(0))).over(w))
    parts = parts.groupBy(*key, "_p").agg(F.min("_a").alias("start"), F.max("_a").alias("end"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*key)
    parts = parts.withColumn("_last", F.max("_p").over(whole)).withColumn("_low", F.min("start").over(whole)).withColumn("_high", F.max("end").over(whole))
    wraps = (F.col("_last") > 0) & (F.col("_low") + 360 - F.col("_high") <= gap)
    joined = parts.withColumn("_p", F.when(wraps & (F.col("_p") == F.col("_last")), F.lit(0)).otherwise(F.col("_p")))
    out = joined.groupBy(*key, "_p").agg(F.max_by("start", "start").alias("_s"), F.min("start").alias("_s0"), F.min("end").alias("_e0"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("_k"), F.max("end").alias("_e"))
    out = out.select(*key, F.when(F.col("_k") > 1, F.col("_s")).otherwise(F.col("_s0")).alias("start"), F.when(F.col("_k") > 1, F.col("_e0")).otherwise(F.col("_e")).alias("end"), "n")
    return out.withColumn("arc", F.row_number().over(Window.partitionBy(*key).orderBy("start")))


def monotonic_fraction(df: DataFrame, key: list[str], order: list[str], value: str, rising: bool = True, still: float = 1e-6) -> DataFrame:
    """(key, fraction): share of the steps of at least ``still`` that go the right way; 1 if there is none."""
    w = Window.partitionBy(*key).orderBy(*order)
    step = df.select(*key, (F.col(value) - F.lag(value).over(w)).alias("_d"))
    moved = F.abs(F.col("_d")) >= still
    right = moved & ((F.col("_d") > 0) if rising else (F.col("_d") < 0))
    return step.groupBy(*key).agg(F.coalesce(F.try_divide(F.count_if(right), F.count_if(moved)), F.lit(1.0)).alias("fraction"))


def span(df: DataFrame, key: list[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg((F.max(value) - F.min(value)).alias("span"))


def bounce(sequence: Column, times: int) -> Column:
    """A B C played forwards and backwards ``times`` times without repeating the turning points: A B C B A ..."""
    back = F.slice(F.reverse(sequence), 2, F.greatest(F.size(sequence) - 1, F.lit(0)))
    forth = F.slice(sequence, 2, F.greatest(F.size(sequence) - 1, F.lit(0)))
    parts = [sequence] + [back if i % 2 else forth for i in range(1, times)]
    return F.concat(*parts)


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two integer hashes."""
    return F.bit_count(a.bitwiseXOR(b))
