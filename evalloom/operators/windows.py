"""Top-k and balanced selection in closed form: strata, diverse top-k, water-filling, caps and interleaving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.session import cut_lineage

#: Rows of one key that a single task may sort; keys with more are sorted by ranges.
HOT_ROWS = 2_000_000


def running_total(df: DataFrame, keys: list[str], order: list, amount: Column, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows of the key up to this one in ``order``, which should end in a unique column. Null keys form a key.

    Keys of more than ``hot_rows`` rows, of which there are at most rows / hot_rows, are not sorted in one task: their rows are dealt to tasks by ranges of
    (key, order), each range is added up, and rows add the sums of the ranges before theirs to the running sum within it.
    """
    w = lambda *k: Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot")).where(F.col("_hot") > hot_rows)
    hot = hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_hot").collect()
    if not hot:
        return df.withColumn(name, F.sum(amount).over(w(*keys)))
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    listed = F.broadcast(df.sparkSession.createDataFrame([tuple(r)[:-1] for r in hot], ", ".join(f"_h{i} {t}" for i, t in enumerate(kinds))))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
    rest = df.join(listed, same, "left_anti").withColumn(name, F.sum(amount).over(w(*keys)))
    ranges = 2 * sum(-(-r["_hot"] // hot_rows) for r in hot)
    # Written before the ranges are numbered: a range computed again elsewhere must be the same one.
    dealt = cut_lineage(df.join(listed, same, "left_semi").repartitionByRange(ranges, *keys, *order)).withColumn("_range", F.spark_partition_id())
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_range").alias("_range_of"), before.alias("_ranges_before"))
    found = dealt.withColumn(name, F.sum(amount).over(w(*keys, "_range"))).join(sums, same & (F.col("_range") == F.col("_range_of")))
    return rest.unionByName(found.select(*df.columns, (F.col(name) + F.coalesce("_ranges_before", F.lit(0))).alias(name)))


def top_k(df: DataFrame, strata: list[str], order: list, k: int, position: str = "position") -> DataFrame:
    """The first ``k`` rows of each stratum in ``order``, which should end in a unique column. For k up to a thousand Spark limits groups before the
    shuffle, so a hot stratum sends k rows a task."""
    at = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn(position, at).where(F.col(position) <= k)


def two_pass_diverse(df: DataFrame, group: str, tag: str, quality: str, ident: str, k: int) -> DataFrame:
    """Per group: the best row of each tag first, then the rest by quality, up to ``k``. Adds ``position``. Ties by ident."""
    first = F.row_number().over(Window.partitionBy(group, tag).orderBy(F.desc_nulls_last(quality), ident))
    ranked = df.withColumn("_in_tag", first).where(F.col("_in_tag") <= k)
    return top_k(ranked, [group], [F.col("_in_tag") > 1, F.desc_nulls_last(quality), F.col(ident)], k).drop("_in_tag")


def even_quotas(capacities: Column, total: Column) -> Column:
    """Smallest first, each of n buckets gets min(capacity, remaining // buckets left): array<struct<name, capacity, quota>>.

    ``capacities``: array<struct<name, capacity>>. For a handful of buckets in one row.
    """
    ordered = F.array_sort(F.transform(capacities, lambda x: F.struct(x["capacity"].cast("long").alias("capacity"), x["name"].alias("name"))))
    start = F.struct(total.cast("long").alias("left"), F.size(ordered).cast("long").alias("n"), F.array().cast("array<struct<name:string,capacity:long,quota:long>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        quota = F.least(x["capacity"], F.floor(acc["left"] / acc["n"]))
        row = F.struct(x["name"].cast("string").alias("name"), x["capacity"].alias("capacity"), quota.alias("quota"))
        return F.struct((acc["left"] - quota).alias("left"), (acc["n"] - 1).alias("n"), F.array_append(acc["out"], row).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def fair_targets(capacities: dict[str, int], total: int) -> dict[str, int]:
    """Max-min fair shares of ``total``: everyone gets the same level, or its capacity where that is less; what is left over after whole
    levels goes one by one to the names that have room, least share and name first."""
    left, shares = min(total, sum(capacities.values())), dict.fromkeys(capacities, 0)
    open_names = sorted(k for k, v in capacities.items() if v > 0)
    while left and open_names:
        level = max(1, min(left // len(open_names), min(capacities[k] - shares[k] for k in open_names)))
        for k in sorted(open_names, key=lambda k: (shares[k], k)):
            if left:
                shares[k] += level
                left -= level
        open_names = [k for k in open_names if shares[k] < capacities[k]]
        if left < len(open_names):
            for k in sorted(open_names, key=lambda k: (shares[k], k))[:left]:
                shares[k] += 1
            left = 0
    return shares


def fill_level(sizes: list[tuple[int, int]], total: int) -> tuple[int, int]:
    """(level, left): the level to which ``total`` rows fill all buckets, and how many are left over for buckets that reach above it.

    ``sizes``: (size, how many buckets have it), rising.
    """
    level, left, open_ = 0, max(0, total), sum(k for _, k in sizes)
    for size, k in sizes:
        if (size - level) * open_ > left:
            break
        left -= (size - level) * open_
        level, open_ = size, open_ - k
    return (level + left // open_, left % open_) if open_ else (level, 0)


def _filled(ranked, bucket: str, df: DataFrame, total: int, extra: list) -> DataFrame:
    """Rows of ``ranked(k)``, the first k rows of each bucket by their column ``level``, up to the fill level; the rows left over go, one each, to the first buckets in order ``extra``.

    How far buckets are filled follows from how many there are of each size (sizes above ``total`` count as that), a short list.
    """
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_n", F.least("_rows", F.lit(max(0, total))))
    sizes = counts.groupBy("_n").agg(F.count(F.lit(1)).alias("k")).collect()
    level, left = fill_level(sorted((r["_n"], r["k"]) for r in sizes), total)
    more = counts.where(F.col("_n") > level).orderBy(*extra).limit(left).select(F.col(bucket).alias("_more"), F.lit(True).alias("_one"))
    out = ranked(max(1, level + 1)).join(more, F.col(bucket).eqNullSafe(F.col("_more")), "left")
    return out.where((F.col("level") <= level) | F.col("_one")).drop("_more", "_one")


def water_fill(df: DataFrame, bucket: str, order: list, total: int) -> DataFrame:
    """The rows that filling the emptiest bucket again and again would take: by rank in bucket, then bucket, up to ``total``. Adds ``level``. Null buckets are left out.

    Buckets may be many; hot ones send their first rows only.
    """
    known = df.where(F.col(bucket).isNotNull())
    return _filled(lambda k: top_k(known, [bucket], order, k, "level"), bucket, known, total, [F.col(bucket)])


def hierarchical_fill(df: DataFrame, levels: list[str], order: list, total: int) -> DataFrame:
    """Up to ``total`` rows, spread evenly over the values of the first level: smallest first, each gets all it has or an equal part of what remains, so that the rest goes to the
    larger ones. Within a value rows alternate over the values of the second level, within each of those over the third's, and so on. Adds ``level``, the place within the first-level
    value. ``order`` should end in a unique column; null is a value of its own."""
    first = levels[0]

    def ranked(k: int) -> DataFrame:
        out, at = df, list(order)
        for i in range(len(levels), 0, -1):
            out = top_k(out, levels[:i], at, k, f"_turn{i}")
            at = [F.col(f"_turn{i}"), F.col(levels[i - 1])]
        return out.withColumnRenamed("_turn1", "level").drop(*[f"_turn{i}" for i in range(2, len(levels) + 1)])

    return _filled(ranked, first, df, total, [F.desc("_rows"), F.desc_nulls_last(first)])


def cap_running_size(df: DataFrame, bucket: str, order: list, size: str, cap: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of each bucket in order while the sizes before them are under the cap; ``room`` is what the cap leaves a row, so the last may be truncated."""
    run = running_total(df, [bucket], order, F.col(size), "_run", hot_rows).withColumn("_before", F.col("_run") - F.col(size))
    return run.where(F.col("_before") < cap).withColumn("room", F.least(F.col(size), F.lit(cap) - F.col("_before"))).drop("_run", "_before")


def interleave(df: DataFrame, kind: str, kinds: list[str], order: list, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds (``turn``, ``seat``) by which rows of the listed kinds alternate: first of each kind, second of each, and so on."""
    seat = F.lit(len(kinds))
    for i, k in enumerate(kinds):
        seat = F.when(F.col(kind) == k, F.lit(i)).otherwise(seat)
    return running_total(df, [kind], order, F.lit(1), "turn", hot_rows).withColumn("seat", seat)


def even_positions(i: Column, n: Column, count: int) -> Column:
    """Whether place ``i`` (from 0) is one of ``count`` evenly spread places of a ring of ``n``: round-half-even of k * n / count, modulo n."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.pmod(F.bround(k.cast("double") * n / F.lit(count), 0).cast("long"), n))
    return (n <= count) | F.array_contains(picks, i.cast("long"))


def middle_third(i: Column, n: Column) -> Column:
    """Whether place ``i`` (from 0) of ``n`` lies in [n // 3, 2 n // 3)."""
    return (i >= F.floor(n / 3)) & (i < F.floor(2 * n / 3))


def quotas(total: int, n: int) -> list[int]:
    """``total`` in ``n`` near-equal parts, larger ones first."""
    return [total // n + (i < total % n) for i in range(n)]


def top_distinct(df: DataFrame, group: str, item: str, order: list, n: int) -> DataFrame:
    """Per group the best row of each item, then the ``n`` best of those. ``order`` should end in a unique column."""
    best = df.withColumn("_in_item", F.row_number().over(Window.partitionBy(group, item).orderBy(*order))).where("_in_item = 1").drop("_in_item")
    return top_k(best, [group], order, n)
