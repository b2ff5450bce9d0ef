"""Shared pieces: keys under which differently written values are equal, deliveries, hashed draws and budget cuts."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Ranges of a hash into which running totals are cut.
BUCKETS = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of strings and numbers as a frame that no Python worker has to unpack; none is an empty frame of that schema."""
    kind = StructType.fromDDL(schema)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    text = json.dumps([dict(zip(kind.names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), ArrayType(kind))))


def setting(spark: SparkSession, folder: str, name: str) -> float:
    """One amount of plan_settings (a handful of rows)."""
    row = table(spark, folder, "plan_settings").where(F.col("setting") == name).select("amount").head()
    if row is None:
        raise ValueError(f"plan_settings has no {name}")
    return float(row[0])


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def squash(c: Column) -> Column:
    """Letters and digits only, in lower case: one value for all spellings that differ in case and separators. Blank is null."""
    return blank_to_null(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")))


def scene_key(c: Column) -> Column:
    """The numbers of a scene id without leading zeros; the squashed text where it has no number; null where blank."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.when(F.size(numbers) > 0, F.concat_ws("_", numbers)).otherwise(squash(c))


def label_keys(c: Column) -> Column:
    """Sorted squashed labels; what follows a '|' is no part of a label and an empty label is none. Null where none is left."""
    keys = F.filter(F.transform(c, lambda x: squash(F.substring_index(x, "|", 1))), lambda x: x.isNotNull())
    return F.when(F.size(keys) > 0, F.array_sort(keys))


def nearest_category(c: Column, categories: list[str], most: int = 2) -> Column:
    """The category written as ``c``, up to case, separators and ``most`` mistyped letters; null where none is that near.

    Of several equally near ones the first in ``categories`` counts. The edit distance is only computed where no exact match holds.
    """
    key = squash(c)
    plain = {x: "".join(ch for ch in x.lower() if ch.isalnum()) for x in categories}
    exact, near = F.lit(None).cast("string"), F.lit(None).cast("string")
    for x in reversed(categories):
        exact = F.when(key == plain[x], F.lit(x)).otherwise(exact)
    for d in range(most, 0, -1):
        for x in reversed(categories):
            near = F.when(F.levenshtein(key, F.lit(plain[x])) == d, F.lit(x)).otherwise(near)
    return F.coalesce(exact, near)


def current_delivery(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The latest row of each key by ``at``; rows of one time are told apart by a hash of ``columns``, so any arrangement gives the same row.

    Null keys are dropped. A hot key is combined on the map side before the shuffle.
    """
    order = F.struct(F.col(at), F.xxhash64(*columns))
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return picked.select(key, "_row.*")


def unit_hash(*parts: Column | str, salt: str | int = 0) -> Column:
    """A number in (0, 1) drawn by hashing: the same for the same values on every run and in every arrangement."""
    h = F.xxhash64(F.lit(str(salt)), *parts)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / F.lit(float(2**52))


def md5_unit(ident: Column, salt: str) -> Column:
    """A number in (0, 1) from the first 48 bits of the MD5 of salt and ident: the same in any engine. A null ident has the draw of an empty one."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(ident.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**48))


def salt_of(c: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit("salt")), F.lit(salts)).cast("int")


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = 8, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys on the ``big`` side go to ``salts`` tasks: ``small`` (one row a key) is repeated once a salt."""
    left = big.withColumn("_salt", salt_of(spread, salts))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def budget_cuts(df: DataFrame, key: str, position: str, size: Column, ident: str, budgets: DataFrame, keys: int) -> DataFrame:
    """(key, taken, last): for each key of ``budgets`` (key, budget; ``keys`` rows) how much the longest prefix of its rows in order of
    ``position`` and ``ident`` that fits the budget adds up to, and the (position, ident) of its last row; 0 and null where not even the first row fits.

    Positions, in [0, 1], fall into equal ranges. Ranges are added up on the map side, and only the rows of the one range in which a
    key's budget runs out are sorted, so a key with most of all rows is no hot task. Rows of a null key or size are in no prefix.
    """
    ranges = max(64, min(65_536, 4_000_000 // max(1, keys)))
    b = df.select(F.col(key).alias("_k"), F.col(position).alias("_p"), F.col(ident).alias("_i"), size.alias("_size")).where(F.col("_k").isNotNull() & F.col("_size").isNotNull())
    b = b.withColumn("_b", F.least(F.floor(F.col("_p") * ranges), F.lit(ranges - 1)).cast("int"))
    sums = b.groupBy("_k", "_b").agg(F.sum("_size").alias("_s"), F.max(F.struct("_p", "_i")).alias("_end"))
    upto = F.sum("_s").over(Window.partitionBy("_k").orderBy("_b"))
    plan = budgets.select(F.col(key).alias("_bk"), "budget")
    sums = sums.withColumn("_upto", upto).join(plan, F.col("_k") == F.col("_bk"))
    fits = F.col("_upto") <= F.col("budget")
    cuts = sums.groupBy("_k").agg(
        F.max(F.when(fits, F.col("_upto"))).alias("_before"), F.max(F.when(fits, F.col("_end"))).alias("_end"), F.min(F.when(~fits, F.col("_b"))).alias("_cb"), F.first("budget").alias("_budget"))
    cuts = cuts.withColumn("_before", F.coalesce("_before", F.lit(0).cast(sums.schema["_upto"].dataType)))
    # One row a key, at most one a row of ``budgets``: whether it is broadcast Spark decides by its size.
    open_ = b.join(cuts.where(F.col("_cb").isNotNull()).select(F.col("_k").alias("_ck"), "_cb", "_before", "_budget"), (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb")))
    run = F.sum("_size").over(Window.partitionBy("_k").orderBy("_p", "_i").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    more = open_.withColumn("_run", run).where(F.col("_run") <= F.col("_budget")).groupBy("_k").agg(F.max("_run").alias("_run"), F.max(F.struct("_p", "_i")).alias("_more"))
    out = cuts.join(more.withColumnRenamed("_k", "_mk"), F.col("_k") == F.col("_mk"), "left")
    return out.select(F.col("_k").alias(key), F.greatest("_before", "_run").alias("taken"), F.greatest("_end", "_more").alias("last"))


def spread_small(df: DataFrame) -> DataFrame:
    """``df`` for work that is slow a row: a table in fewer pieces than there are cores, and so a small one, is dealt out to all of them; any other is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def finite(x: float) -> bool:
    return not (math.isnan(x) or math.isinf(x))
