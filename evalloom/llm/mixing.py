"""Mixing sources to target weights: whole epochs first, then a quality-weighted sample up to the token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import budget_cuts, local_rows, unit_hash
from evalloom.session import cut_lineage


def unique_texts(docs: DataFrame, ident: str, source: str, fingerprint: str, tokens: str, quality: str) -> DataFrame:
    """(ident, source, tokens, quality): one row a text (the smallest ident of those with its fingerprint), texts without tokens or source left out.

    Copies are combined on the map side, so a text with a third of all rows is no hot spot.
    """
    there = docs.where((F.col(tokens) > 0) & F.col(source).isNotNull() & F.col(fingerprint).isNotNull() & F.col(ident).isNotNull())
    one = there.groupBy(fingerprint).agg(F.min_by(F.struct(F.col(ident).alias("ident"), F.col(source).alias("source"), F.col(tokens).alias("tokens"), F.col(quality).alias("quality")), F.struct(ident, source)).alias("r"))
    return one.select("r.*")


def mix(texts: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, seed: int = 23) -> tuple[DataFrame, list[tuple]]:
    """The mix (ident, source, tokens, uses) and its report, one row a source of ``targets`` ({source: (share, most repeats)}).

    ``texts``: (ident, source, tokens, quality), see unique_texts; idents are unique. ``total``: tokens of the whole mix; if not given, the most for
    which every source that has texts can reach its share within its repeats. A source's budget is its share of the total, at most repeats * its tokens.

    Each text is used in all complete epochs that fit the budget. What then remains is filled by weighted sampling without replacement: the
    exponential key -ln(u)/w of a text, w its quality, is sorted within the source and sizes are summed up to the budget. Of the texts not reached, the
    one whose size is nearest to what is left (ties: the larger, then by key) closes the budget if that ends nearer to it, or if the source
    would have no text at all. So no source is filtered to nothing because its texts are large. Texts without a positive quality come last, in random order.
    Report: (source, target_share, actual_share, tokens, budget, available_tokens, epochs, most_repeats). Sources that are no target are
    left out; a target without texts has an actual share of 0.
    """
    if any(share < 0 or repeats < 0 for share, repeats in targets.values()):
        raise ValueError("shares and repeats must not be negative")
    spark = texts.sparkSession
    q = F.when(F.col("quality") > 0, F.nanvl("quality", F.lit(0.0)))
    texts = cut_lineage(texts.where(F.col("source").isin(*targets)).select("ident", "source", "tokens", F.when(q > 0, q).alias("w")))
    sums = {r["source"]: (r["n"], r["w"]) for r in texts.groupBy("source").agg(F.sum("tokens").alias("n"), F.avg("w").alias("w")).collect()}
    there = {s: n for s, (n, _) in sums.items()}
    if total is None:
        total = min((m * there[s] / w for s, (w, m) in targets.items() if w > 0 and there.get(s)), default=0.0)
    plan = []
    for s, (w, m) in targets.items():
        if there.get(s):
            budget = min(round(w * total), m * there[s])
            epochs = budget // there[s]
            plan.append((s, int(epochs), int(budget - epochs * there[s]), int(budget), float(sums[s][1] or 1.0)))
    if not plan:
        empty = texts.select("ident", "source", "tokens", F.lit(0).alias("uses")).where("false")
        return empty, [(s, w, 0.0, 0, 0.0, there.get(s, 0), 0, m) for s, (w, m) in targets.items()]
    # One row a target: small enough to be sent everywhere.
    wanted = F.broadcast(local_rows(spark, plan, "_s string, _epochs int, budget bigint, _whole bigint, _mean double"))
    u = unit_hash(F.col("ident"), salt=f"mix{seed}")
    # 1 - u**(mean/w) grows with the key -ln(u)/w and lies in (0, 1), about evenly spread; texts without a weight follow.
    keyed = texts.join(wanted, F.col("source") == F.col("_s")).select(
        "ident", "source", "tokens", F.col("_epochs").alias("epochs"), "budget", F.coalesce((1 - F.pow(u, F.col("_mean") / F.col("w"))) / 2, 0.5 + u / 2).alias("at")
    )
    open_ = keyed.where(F.col("budget") > 0)
    budgets = wanted.where(F.col("budget") > 0).select(F.col("_s").alias("source"), "budget")
    cuts = {r["source"]: (r["taken"], r["last"]) for r in budget_cuts(open_, "source", "at", F.col("tokens"), "ident", budgets, len(plan)).collect()}
    left = []
    for s, epochs, rest, _, _ in plan:
        if s in cuts:
            taken, end = cuts[s]
            left.append((s, rest - taken, not epochs and not taken, *(end or (-1.0, None))))
    ids = texts.schema["ident"].dataType.simpleString()
    ends = F.broadcast(local_rows(spark, left, f"_e string, _left bigint, _bare boolean, _at double, _id {ids}"))
    inside = F.coalesce((F.col("at") < F.col("_at")) | ((F.col("at") == F.col("_at")) & (F.col("ident") <= F.col("_id"))), F.lit(False))
    placed = keyed.join(ends, F.col("source") == F.col("_e"), "left")
    gap = F.abs(F.col("tokens") - F.col("_left"))
    fits = ~inside & (F.col("_left") > 0) & (F.col("_bare") | (gap < F.col("_left")))
    closing = placed.where(fits).groupBy("source").agg(F.min(F.struct(gap.alias("gap"), -F.col("tokens"), "at", "ident")).alias("c")).collect()  # one row a source
    closers = F.broadcast(local_rows(spark, [(r["source"], r["c"]["ident"]) for r in closing], f"_c string, _closer {ids}"))
    uses = F.col("epochs") + F.when(inside | F.coalesce(F.col("ident") == F.col("_closer"), F.lit(False)), 1).otherwise(0)
    out = placed.join(closers, F.col("source") == F.col("_c"), "left").select("ident", "source", "tokens", uses.cast("int").alias("uses"))
    out = cut_lineage(out.where(F.col("uses") > 0))
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("n")).collect()}
    everything = sum(got.values())
    byname = {s: (e, b) for s, e, _, b, _ in plan}
    report = [
        (s, w, (got.get(s, 0) / everything if everything else 0.0), got.get(s, 0), float(byname.get(s, (0, 0))[1]), there.get(s, 0), byname.get(s, (0, 0))[0], m) for s, (w, m) in targets.items()
    ]
    return out, report


REPORT = "source string, target_share double, actual_share double, tokens bigint, budget double, available_tokens bigint, epochs int, most_repeats int"
