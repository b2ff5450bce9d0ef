"""A sample that stays the same on every run and only grows: hash thresholds by stratum that are never lowered."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import local_rows

SPACE = 16**12


def salted_position(ident: Column, salt: str) -> Column:
    """The first 48 bits of the MD5 of salt and ident, as a long; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), ident)), 1, 12), 16, 10).cast("long")


def raise_thresholds(rates: dict[str, float], earlier: dict[str, float] | None = None, default: float | None = None) -> dict[str, float]:
    """New threshold of each stratum: its rate, or its earlier threshold where that is higher, so that earlier picks remain picked.

    A stratum that only ``earlier`` knows keeps its threshold there. ``default``, the rate of strata not listed, is held under the key "".
    """
    new = {**(earlier or {})}
    for stratum, rate in {**rates, **({} if default is None else {"": default})}.items():
        if not 0 <= rate <= 1:
            raise ValueError(f"rate of {stratum!r} is not between 0 and 1")
        new[stratum] = max(rate, new.get(stratum, new.get("", 0.0) if stratum else 0.0))
    if "" in new:
        for stratum in set(earlier or {}) - {""} - set(rates):
            new[stratum] = max(new[stratum], new[""])
    return new


def save_thresholds(spark: SparkSession, thresholds: dict[str, float], folder: str) -> None:
    """Writes the thresholds (stratum, threshold) for the runs to come; ``folder`` must be new, so that no earlier state is lost if the write fails."""
    local_rows(spark, sorted(thresholds.items()), "stratum string, threshold double").coalesce(1).write.parquet(folder)


def load_thresholds(spark: SparkSession, folder: str) -> dict[str, float]:
    """What save_thresholds wrote: one row a stratum that was given a rate."""
    return {r["stratum"]: r["threshold"] for r in spark.read.parquet(folder).collect()}


def stable_sample(df: DataFrame, ident: str, stratum: Column, thresholds: dict[str, float], salt: str = "stable") -> DataFrame:
    """(ident, stratum): the distinct ids whose salted position is under their stratum's threshold. Null ids are dropped.

    Whether an id is picked depends on it, its stratum and the threshold only, not on other rows, so it is the same on every run and
    arrangement, and remains when rows are added or thresholds raised. ``stratum`` must not change between the rows of an id;
    where it does, one row under its threshold suffices. Strata without a threshold of their own take that of "" (else 0). The filter
    runs before the distinct, so only picked ids are shuffled.
    """
    limit = F.lit(float(thresholds.get("", 0.0)))
    name = F.coalesce(stratum.cast("string"), F.lit(""))
    if own := {k: float(v) for k, v in thresholds.items() if k}:
        limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*own.items())]), name), limit)
    slim = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("ident"), name.alias("stratum"), limit.alias("_limit"))
    picked = slim.where(salted_position(F.col("ident"), salt) < F.col("_limit") * F.lit(float(SPACE)))
    return picked.groupBy("ident").agg(F.min("stratum").alias("stratum"))
