"""Capping records per dominant contributor by a score-weighted reservoir of exponential keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.common import md5_unit, salt_of, salted_join
from evalloom.session import cut_lineage

#: -ln(-ln u) of the draws, which lie between 1 / 2**49 and 1 - 1 / 2**49, is within these bounds.
NOISE = (-3.6, 34.0)
#: Temperature at which the best scores are all but sure to have the largest keys; the settling step corrects the rest.
COLD = 1e-4


def reservoir_key(score: Column, ident: Column, temperature: float, seed: int) -> Column:
    """Sort key of weighted reservoir sampling without replacement, largest kept; null where the score is not positive.

    An exponential variable -ln u scaled by the score w, (-ln u) / w**(1/t), is smallest for the rows to keep; its logarithm, negated and times t,
    is ln(w) - t ln(-ln u), the same order. At t = 1 rows are kept in proportion to the score; as t falls the order nears that of the scores.
    u comes from the MD5 of seed and ident, so every run and engine draws the same.
    """
    return F.when(score > 0, F.ln(score)) - F.lit(float(temperature)) * F.ln(-F.ln(md5_unit(ident, f"reservoir{seed}")))


def _cap_th(rows: DataFrame, order: str, limit: Column, cap: int, salts: int) -> DataFrame:
    """(_c, _last): the value of ``order`` of the row at place ``limit`` (a column, one value a contributor, at most ``cap``) of each contributor that has so many.

    Found in two levels, over (contributor, salt) and then over at most salts * cap rows, so no contributor is sorted in one task.
    """
    slim = rows.select("_c", order, limit.alias("_limit"), salt_of(F.col("_id"), salts).alias("_s"))
    first = slim.withColumn("_n", F.row_number().over(Window.partitionBy("_c", "_s").orderBy(order))).where(F.col("_n") <= cap)
    second = first.drop("_n", "_s").withColumn("_n", F.row_number().over(Window.partitionBy("_c").orderBy(order))).where(F.col("_n") <= cap)
    return second.where(F.col("_n") == F.col("_limit")).select("_c", F.col(order).alias("_last"))


def cap_per_contributor(df: DataFrame, ident: str, contributor: str, score: str, cap: int, temperature: float = 1.0, best: bool = False, seed: int = 17, salts: int = 8) -> DataFrame:
    """Marks, in ``kept``, at most ``cap`` rows of each contributor: those of the largest reservoir keys.

    At temperature 1 that is sampling without replacement with probability proportional to the score. Rows whose score is not positive have no key and come after
    all others: zero before negative before blank or NaN, ties by the smaller ident. Rows without a contributor are all kept. A null
    ident ranks first among ties; rows that repeat an ident are ranked and counted as rows of their own. Returns (ident, contributor, score, reservoir_key, kept), a
    score of NaN as null; other columns of ``df`` are not looked at. An empty table gives none.

    ``best``: the highest scores are wanted. The reservoir then runs at the temperature COLD, and its cap-th key K stands for the cap-th score: as the
    noise of a key is bounded, a row whose ln(score) lies above K by more than the bound is among the best and one as far below is not. Only
    rows in between are settled, by comparing the scores themselves, for the places that the sure ones leave.

    The keys of the rows are compared with the cap-th in a join that spreads hot contributors over salts. Only contributors with cap rows or more have
    a cap-th key, so the table of them has at most rows / cap rows.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")
    if {ident, contributor, score} & {"reservoir_key", "kept"}:
        raise ValueError("reservoir_key and kept are names of the result")
    heat = COLD if best else float(temperature)
    if heat <= 0:
        raise ValueError("temperature must be positive; use best for the highest scores")
    v = F.col(score).cast("double")
    base = df.select(F.col(ident).alias("_id"), F.col(contributor).alias("_c"), F.when(~F.isnan(v), v).alias("_v"))
    # Classes: 0 with a key, 1 without a positive score, 2 blank. ``neg`` puts larger keys, or scores, first.
    keyed = base.withColumn("_key", reservoir_key(F.col("_v"), F.col("_id"), heat, seed))
    kind = F.when(F.col("_key").isNotNull(), 0).when(F.col("_v").isNotNull(), 1).otherwise(2)
    keyed = keyed.withColumn("_rank", F.struct(kind.alias("kind"), F.coalesce(-F.col("_key"), -F.col("_v"), F.lit(0.0)).alias("neg"), F.col("_id").alias("id")))
    keyed = cut_lineage(keyed)  # read two or three times; what leads to it may be dear
    last = _cap_th(keyed.where(F.col("_c").isNotNull()), "_rank", F.lit(cap), cap, salts)
    if best:
        last = _settled(keyed, last, cap, salts)
        rank = F.struct(kind.alias("kind"), F.coalesce(-F.col("_v"), F.lit(0.0)).alias("neg"), F.col("_id").alias("id"))
    else:
        rank = F.col("_rank")
    joined = salted_join(keyed, last, "_c", F.col("_id"), salts, "left")
    kept = F.coalesce(rank <= F.col("_last"), F.lit(True))
    return joined.select(F.col("_id").alias(ident), F.col("_c").alias(contributor), F.col("_v").alias(score), F.col("_key").alias("reservoir_key"), kept.alias("kept"))


def _settled(keyed: DataFrame, last: DataFrame, cap: int, salts: int) -> DataFrame:
    """(_c, _last) by score instead of by key: the cap-th of each contributor among the rows that the noise could have moved across its cap-th key."""
    near = salted_join(keyed.where(F.col("_c").isNotNull()).select("_c", "_id", "_v", "_rank"), last, "_c", F.col("_id"), salts)
    same = F.col("_rank.kind") == F.col("_last.kind")
    # The cap-th score s obeys s + low <= K <= s + high, so ln s lies between K - high and K - low; a hair more for rounding.
    gap = F.ln("_v") + F.col("_last.neg")  # ln(score) - K
    low, high = -NOISE[1] * COLD - 1e-9, -NOISE[0] * COLD + 1e-9
    sure = (F.col("_rank.kind") < F.col("_last.kind")) | (same & (F.col("_last.kind") == 0) & (gap > high)) | (same & (F.col("_last.kind") > 0) & (F.col("_rank") < F.col("_last")))
    open_ = same & F.when(F.col("_last.kind") == 0, (gap >= low) & (gap <= high)).otherwise(F.col("_rank") == F.col("_last"))
    near = near.select("_c", "_id", sure.alias("_sure"), open_.alias("_open"), F.struct(F.col("_rank.kind").alias("kind"), F.coalesce(-F.col("_v"), F.lit(0.0)).alias("neg"), F.col("_id").alias("id")).alias("_score"))
    places = near.groupBy("_c").agg((F.lit(cap) - F.count_if("_sure")).alias("_places"))
    rows = salted_join(near.where("_open").select("_c", "_id", "_score"), places, "_c", F.col("_id"), salts)
    return _cap_th(rows, "_score", F.col("_places"), cap, salts)
