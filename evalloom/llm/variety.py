"""Choosing a varied subset: density from repeated locality-sensitive hashes, then a sample of probability inverse to it."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import md5_unit, salt_of
from evalloom.session import cut_lineage


def projections(features: int, tables: int, hashes: int, width: float, seed: int) -> list[list[tuple[float, list[float]]]]:
    """For each hash table its ``hashes`` random projections: a shift within the cell width, and a factor from the normal distribution for each feature."""
    rng = random.Random(seed)
    return [[(rng.uniform(0, width), [rng.gauss(0, 1) for _ in range(features)]) for _ in range(hashes)] for _ in range(tables)]


def lsh_buckets(features: list[Column], tables: int, hashes: int, width: float, seed: int) -> Column:
    """Array with the bucket of each of ``tables`` p-stable hash functions: the cells, of ``width``, of all its projections together."""
    out = []
    for table in projections(len(features), tables, hashes, width, seed):
        cells = []
        for shift, factors in table:
            total = F.lit(shift)
            for x, f in zip(features, factors, strict=True):
                total = total + x * F.lit(f)
            cells.append(F.floor(total / F.lit(width)).cast("long"))
        out.append(F.xxhash64(*cells))
    return F.array(*out)


def setting_density(df: DataFrame, setting: list[str], features: list[Column], tables: int = 8, hashes: int = 4, width: float = 1.5, seed: int = 5) -> DataFrame:
    """(setting columns, setting_rows, density): for each distinct setting the mean, over the hash tables, of the rows in its bucket.

    Rows are added up by setting before anything is hashed, so a setting with a third of all rows is one row from then on. Nulls
    in a setting column form a value of their own; a null feature must have been replaced by a number.
    """
    counts = df.groupBy(*setting).agg(F.count(F.lit(1)).alias("setting_rows"))
    hashed = counts.withColumn("_sid", F.xxhash64(F.to_json(F.struct(*setting))))
    buckets = hashed.select("_sid", "setting_rows", F.posexplode(lsh_buckets(features, tables, hashes, width, seed)).alias("_t", "_b"))
    sums = buckets.groupBy("_t", "_b").agg(F.sum("setting_rows").alias("_rows"))
    density = buckets.join(sums, ["_t", "_b"]).groupBy("_sid").agg(F.avg("_rows").alias("density"))
    return hashed.join(density, "_sid").drop("_sid")


def density_weighted(df: DataFrame, ident: str, setting: list[str], features: list[Column], size: int, tables: int = 8, hashes: int = 4, width: float = 1.5, seed: int = 5, salts: int = 8) -> DataFrame:
    """(ident, setting columns, density, draw_key, drawn) for every row: the exponential key of a weighted sample without replacement with weight
    1/density, and whether the row is one of the ``size`` of the smallest keys (ties by ident), which are the varied subset.

    The table of settings may have any size: it is joined on the setting and a salt, so that rows of one setting, however many, go to ``salts`` tasks, and
    Spark broadcasts it where it turns out to be small. Rows that repeat an ident have the same key and count each; rows of a null ident
    take part. Columns of ``df`` that are not named are not looked at. An empty table gives none.
    """
    base = cut_lineage(df.select(ident, *setting))  # read several times; what leads to it may be dear
    table = cut_lineage(setting_density(base, setting, features, tables, hashes, width, seed).select(*[F.col(c).alias(f"_{c}") for c in setting], "density"))
    table = table.withColumn("_spread", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    rows = base.withColumn("_salt", salt_of(F.col(ident), salts))
    same = rows["_salt"] == table["_spread"]
    for c in setting:
        same = same & rows[c].eqNullSafe(table[f"_{c}"])
    keyed = rows.join(table, same).select(ident, *setting, "density", (-F.ln(md5_unit(F.col(ident), f"variety{seed}")) * F.col("density")).alias("draw_key"))
    place = F.struct(F.col("draw_key").alias("k"), F.col(ident).alias("i"))
    first = keyed.select(place.alias("_p")).orderBy("_p").limit(max(0, int(size)))
    # One value: the last place of the subset, null where the subset is empty.
    return keyed.withColumn("drawn", F.coalesce(place <= first.agg(F.max("_p")).scalar(), F.lit(False)))


def varied_subset(df: DataFrame, **how) -> DataFrame:
    """The rows drawn, at most ``size`` (fewer only where there are fewer); see density_weighted."""
    keyed = density_weighted(df, **how)
    return keyed.orderBy("draw_key", how["ident"]).limit(max(0, int(how["size"]))).drop("drawn")
