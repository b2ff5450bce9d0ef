"""A sample that meets target proportions on several axes: swap repair over counts of category signatures."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import budget_cuts, local_rows, salted_join, unit_hash

#: Cost of one record under a floor, in units of the sample size: more than any deviation from the shares can cost.
FLOOR_WEIGHT = 1e6


def signature_counts(groups: DataFrame, axes: list[str], categories: list[list[str]]) -> dict[tuple, int]:
    """Rows of each combination of categories. Null, and what is no target category of its axis, count as null, a category of its own that no target names.

    So there are at most as many signatures as the product of the target categories plus one, whatever the data hold; they are collected.
    """
    known = [F.when(F.col(a).isin(*names), F.col(a)).alias(f"_a{i}") if names else F.lit(None).cast("string").alias(f"_a{i}") for i, (a, names) in enumerate(zip(axes, categories, strict=True))]
    rows = groups.select(*known).groupBy(*[f"_a{i}" for i in range(len(axes))]).agg(F.count(F.lit(1)).alias("n")).collect()
    return {tuple(r)[:-1]: r["n"] for r in rows}


def _draw(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind ``n`` random draws without replacement from ``have`` bring."""
    out, total, left = np.zeros(len(have), np.int64), int(have.sum()), int(n)
    for i, h in enumerate(have):
        h = int(h)
        if left <= 0:
            break
        if total < 10**9:
            k = int(rng.hypergeometric(h, total - h, left)) if h else 0
        else:  # beyond the generator's range; the draw is nearly normal there
            p = h / total
            k = round(rng.normal(left * p, (left * p * (1 - p) * max(0.0, 1 - left / total)) ** 0.5))
        k = min(max(k, left - (total - h)), h, left)
        out[i], left, total = k, left - k, total - h
    return out


def repair(counts: dict[tuple, int], targets: dict[tuple[int, str], tuple[float, int]], size: int, seed: int = 11) -> dict[tuple, int]:
    """How many of each signature to take: ``size`` in all, as near as exchanges get to the targets.

    ``targets``: (axis number, category) -> (share, least count). The start is random: floors are filled from random rows, scarcest category first, and
    the rest is drawn at random from all that is left. Then signatures exchange counts as long as that lowers the squared deviation from share * size, where a
    category under its floor weighs far more, the best exchange first, in steps that halve down to single rows. Ends when no exchange of one row helps.

    Only counts are held, so the work does not grow with the rows. The gain of moving from signature i to j is a sum over the axes on which
    they differ. So for each set of axes taken as equal the best receiver of each combination on those axes serves all givers, and the best exchange of
    all pairs is found in time linear in the signatures; taking as equal fewer axes than are can only understate a gain.
    """
    rng = np.random.default_rng(seed)
    names = sorted(counts, key=repr)
    axes = len(names[0]) if names else 0
    have = np.array([counts[s] for s in names], np.int64)
    size = int(min(size, have.sum()))
    # Category numbers per axis; the last one stands for categories without a target, which cost nothing.
    keys = [[c for a, c in targets if a == axis] for axis in range(axes)]
    number = [{c: i for i, c in enumerate(k)} for k in keys]
    cat = np.array([[number[a].get(s[a], len(keys[a])) for a in range(axes)] for s in names], np.int64).reshape(len(names), axes)
    want = [np.array([targets[a, c][0] * size for c in keys[a]] + [0.0]) for a in range(axes)]
    least = [np.array([targets[a, c][1] for c in keys[a]] + [0], float) for a in range(axes)]
    counted = [np.array([1.0] * len(keys[a]) + [0.0]) for a in range(axes)]
    take = np.zeros(len(names), np.int64)

    def reached(a: int) -> np.ndarray:
        return np.bincount(cat[:, a], weights=take, minlength=len(keys[a]) + 1)

    scarce = sorted(((have[cat[:, a] == i].sum(), a, i) for a in range(axes) for i in range(len(keys[a]))), key=lambda x: x)
    for _, a, i in scarce:
        pool = np.flatnonzero(cat[:, a] == i)
        short = int(min(least[a][i] - take[pool].sum(), (have - take)[pool].sum(), size - take.sum()))
        if short > 0:
            take[pool] += _draw(rng, (have - take)[pool], short)
    take += _draw(rng, have - take, size - int(take.sum()))

    def cost(a: int, got: np.ndarray) -> np.ndarray:
        return counted[a] * ((got - want[a]) ** 2 + FLOOR_WEIGHT * max(1, size) * np.maximum(0.0, least[a] - got))

    shared = [[a for a in range(axes) if a not in differ] for k in range(1, axes + 1) for differ in combinations(range(axes), k)]
    classes = []
    for same in shared:
        combos = np.zeros(len(names), np.int64)
        for a in same:
            combos = combos * (len(keys[a]) + 1) + cat[:, a]
        classes.append(np.unique(combos, return_inverse=True)[1] if len(names) else combos)

    def best_exchange(n: int) -> tuple[float, int, int]:
        now = [reached(a) for a in range(axes)]
        gives = [(cost(a, now[a]) - cost(a, now[a] - n))[cat[:, a]] for a in range(axes)]
        gets = [(cost(a, now[a]) - cost(a, now[a] + n))[cat[:, a]] for a in range(axes)]
        can_give, can_get = take >= n, have - take >= n
        found = (0.0, -1, -1)
        for same, group in zip(shared, classes, strict=True):
            differ = [a for a in range(axes) if a not in same]
            give = np.where(can_give, sum(gives[a] for a in differ), -np.inf)
            get = np.where(can_get, sum(gets[a] for a in differ), -np.inf)
            order = np.lexsort((-np.arange(len(names)), get, group))
            last = np.flatnonzero(np.diff(np.append(group[order], -1)))  # the best receiver of each class comes last in it
            receiver = order[last]
            total = give + get[receiver][group]
            i = int(np.argmax(total)) if len(total) else -1
            if i >= 0 and total[i] > max(found[0], 1e-9):
                found = (float(total[i]), i, int(receiver[group[i]]))
        return found

    step = max(1, size // 8)
    while step and len(names) > 1:
        while (best := best_exchange(step))[1] >= 0:
            take[best[1]] -= step
            take[best[2]] += step
        step //= 2
    return {s: int(t) for s, t in zip(names, take, strict=True) if t}


REPORT = "axis string, category string, target_share double, min_count bigint, available bigint, needed double, sampled bigint, unmet boolean, cause string"


def quota_sample(groups: DataFrame, ident: str, axes: list[str], targets: dict[tuple[str, str], tuple[float, int]], size: float, seed: int = 11) -> tuple[DataFrame, list[tuple]]:
    """The sampled rows of ``groups`` (ident, axes), round(size) of them or all there are, and the report, one row a target:
    (axis, category, target_share, min_count, available, needed, sampled, unmet, cause).

    ``unmet``: the repaired sample has fewer rows of the category than needed, the larger of min_count and target_share * size. ``cause`` says why: 'available' (there are
    not so many rows), 'rounding' (less than one row is missing), or 'joint' (there are enough, but other targets stand against it). ``ident`` should be
    unique: a repeated row is a row of its own, though all repeats share one place in the order. Within a signature rows are taken in
    hash order, so the choice is random but the same on every run.
    """
    spark: SparkSession = groups.sparkSession
    categories = [[c for a, c in targets if a == axis] for axis in axes]
    counts = signature_counts(groups, axes, categories)
    numbered = {(axes.index(a), c): v for (a, c), v in targets.items()}
    take = repair(counts, numbered, round(size), seed)
    report = []
    for (a, c), (share, least) in targets.items():
        i = axes.index(a)
        there = sum(n for s, n in counts.items() if s[i] == c)
        got = sum(n for s, n in take.items() if s[i] == c)
        needed = max(float(least), share * size)
        cause = None if got >= needed else "available" if there < needed else "rounding" if needed - got < 1 else "joint"
        report.append((a, c, share, least, there, needed, got, got < needed, cause))
    known = [F.when(F.col(a).isin(*names), F.col(a)) if names else F.lit(None).cast("string") for a, names in zip(axes, categories, strict=True)]
    signature: Column = F.to_json(F.struct(*[k.alias(f"_a{i}") for i, k in enumerate(known)]), {"ignoreNullFields": "false"})
    keyed = groups.select(ident, *axes, signature.alias("_sig"), unit_hash(F.col(ident), salt=f"quota{seed}").alias("_pos"))
    plan = local_rows(spark, [(*s, n) for s, n in take.items()], ", ".join(f"`_a{i}` string" for i in range(len(axes))) + ", budget bigint")
    plan = plan.select(F.to_json(F.struct(*[f"_a{i}" for i in range(len(axes))]), {"ignoreNullFields": "false"}).alias("_sig"), "budget")
    cuts = budget_cuts(keyed, "_sig", "_pos", F.lit(1), ident, plan, len(take)).select("_sig", "last")
    picked = salted_join(keyed, cuts, "_sig", F.col(ident)).where(F.struct("_pos", ident) <= F.col("last"))
    return picked.select(ident, *axes), report
