"""Balanced families, picks for targets and bucket passes against plain loops over lists, with pools that fetch a few rows at a time."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalloom.operators import greedy
from evalloom.operators.windows import fair_targets, quotas

COLUMNS = greedy.GroupColumns("g", "family", "scene", "label", "labels", "room", "motion", "answer", "anchor", "dim", "prior", "clips")
NAMES = ["g", "family", "scene", "label", "labels", "room", "motion", "answer", "anchor", "dim", "prior", "clips"]


def groups(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        labels = sorted({rng.choice("abcdef") for _ in range(rng.choice([1, 2]))})
        family = rng.choice(["size", "size", "size", "camera", "camera", "pair"])
        rows.append((f"g{i:03d}", family, rng.choice(["s1", "s1", "s2", "s3", "s4"]), "|".join(labels), labels, rng.choice(["k", "b", None]), rng.choice("xyz"), rng.choice(["1", "2", "3"]), f"o{rng.randint(0, 9)}", rng.choice("lwh") if family == "size" else None, rng.randint(0, 1), rng.randint(1, 9)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, family string, scene string, label string, labels array<string>, room string, motion string, answer string, anchor string, dim string, prior int, clips int")


def plain_families(rows, targets, label_caps, scene_caps, last):
    """The same selection with everything counted afresh from the picks made so far."""
    rows = [dict(zip(NAMES, r, strict=True)) for r in rows]
    picked = []
    there = Counter(r["family"] for r in rows)
    order = sorted(targets, key=lambda f: (there[f] / targets[f], f))

    def choose(pool, k, family, aims):
        local = []
        for _ in range(k):
            singles, scenes = Counter(x for r in picked for x in r["labels"]), Counter(r["scene"] for r in picked)
            fits = [r for r in pool if r not in picked and scenes[r["scene"]] < scene_caps.get(r["scene"], 10**9) and all(singles[x] < label_caps.get(x, 10**9) for x in r["labels"])]
            if not fits:
                return

            def key(r):
                own = [p for p in picked if p["family"] == family]
                n = lambda among, c: sum(p[c] == r[c] for p in among)
                full = [float(n(own, c) >= goal.get(r[c], 0)) for c, goal in aims]
                fill = [n(own, c) / max(1, goal.get(r[c], 1)) for c, goal in aims]
                pair = sum(p["scene"] == r["scene"] and p["label"] == r["label"] for p in local)
                return (*full, n(picked, "scene"), n(own, "scene"), *fill, n(picked, "label"), n(own, "label"), n(own, "motion"), n(own, "answer"), n(picked, "room"), n(own, "room"), pair, n(local, "anchor"), r["prior"], -r["clips"], r["g"])

            best = min(fits, key=key)
            picked.append(best)
            local.append(best)

    for family in order:
        pool, before = [r for r in rows if r["family"] == family], len(picked)
        if family == order[0]:
            choose([r for r in pool if r["scene"] not in last], targets[family], family, [])
            choose([r for r in pool if r["scene"] in last], targets[family] - (len(picked) - before), family, [])
            continue
        aims = [("label", fair_targets(Counter(r["label"] for r in pool), targets[family]))]
        dims = sorted({r["dim"] for r in pool} - {None})
        if len(dims) > 1:
            aims.append(("dim", dict(zip(dims, quotas(targets[family], len(dims)), strict=True))))
        motions = Counter(r["motion"] for r in pool)
        shares = fair_targets(motions, targets[family])
        for m in sorted(shares, key=lambda m: (shares[m], motions[m], m)):
            choose([r for r in pool if r["motion"] == m], shares[m], family, aims)
    return [(r["g"], r["family"], i + 1) for i, r in enumerate(picked)]


@pytest.mark.parametrize(("seed", "most"), [(1, 100_000), (2, 25)])
def test_balanced_families(spark, seed, most):
    rows = groups(seed)
    targets, label_caps, scene_caps = {"size": 12, "camera": 9, "pair": 6}, {"a": 7, "b": 9}, {"s1": 12}
    got = greedy.family_balanced(frame(spark, rows), COLUMNS, targets, label_caps, scene_caps, ["s1"], most)
    assert got == plain_families(rows, targets, label_caps, scene_caps, ["s1"])
    used = {r[0]: r for r in rows}
    assert Counter(x for g, _, _ in got for x in used[g][4])["a"] <= 7 and Counter(used[g][2] for g, _, _ in got)["s1"] <= 12
    with pytest.raises(ValueError, match="for a target of"):
        greedy.family_balanced(frame(spark, rows), COLUMNS, {"pair": 80}, most=most)


@pytest.mark.parametrize("most", [3, 100_000])
def test_picks_for_targets(spark, most):
    rows = groups(5)
    rng = random.Random(6)
    targets = [(rng.choice(["size", "camera"]), rng.choice("xyz")) for _ in range(25)]
    got = greedy.pick_for_targets(frame(spark, rows), "g", ["family", "motion"], targets, "labels", "scene", "room", ["prior"], most)
    picked = []
    for family, motion in targets:
        singles = Counter(x for r in picked for x in r[4])
        fits = [r for r in rows if r not in picked and r[1] == family and r[6] == motion]
        picked.append(min(fits, key=lambda r: (sum(singles[x] for x in r[4]), sum(p[2] == r[2] for p in picked), sum(p[5] == r[5] for p in picked), r[10], r[0])))
    assert got == [(r[0], i + 1) for i, r in enumerate(picked)]
    with pytest.raises(ValueError, match="no candidate"):
        greedy.pick_for_targets(frame(spark, rows), "g", ["family", "motion"], [("none", "x")], "labels", "scene", "room", [], most)


def test_bucket_passes(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 7]), rng.choice("pq"), rng.choice("abc")) for i in range(120)]
    df = spark.createDataFrame(rows, "i bigint, b int, s string, l string")
    places = {r["i"]: r["h"] for r in df.select("i", F.xxhash64(F.lit(0), F.col("i").cast("string")).alias("h")).collect()}
    got = greedy.bucket_passes(df, "i", "b", [2, 0, 1], "s", "l", 15, 12, 11)
    picks, scenes, labels, have = [], Counter(), Counter(), Counter()
    for by_scene, by_label in ((True, True), (False, True), (False, False)):
        for b in (2, 0, 1):
            for i, _, s, l in sorted((r for r in rows if r[1] == b), key=lambda r: (places[r[0]], r[0])):
                if have[b] < 15 and i not in picks and not (by_scene and scenes[s] >= 12) and not (by_label and labels[l] >= 11):
                    picks.append(i)
                    have[b] += 1
                    scenes[s] += 1
                    labels[l] += 1
    assert [x[0] for x in got] == picks and greedy.bucket_passes(df.where("false"), "i", "b", [0], "s", "l", 5, 2, 2) == []


def test_scene_passes(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["s", "t", None]), i, rng.choice("ab"), rng.choice(["x", None]), rng.choice([1, 2, None]), rng.choice([None, float("nan"), rng.random(), 0.5])) for i in range(80)]
    df = spark.createDataFrame(rows, "s string, i int, k string, m string, a int, v double")
    got = sorted((r["s"], r["position"], r["i"]) for r in greedy.scene_three_passes(df, "s", "i", ["k", "m"], "a", "v", 9).collect())
    want = []
    for s in "st":
        pool = sorted((r for r in rows if r[0] == s), key=lambda r: (r[5] is None or r[5] != r[5], -(r[5] or 0) if r[5] == r[5] else 0, r[1]))
        picked, kinds, anchors = [], set(), set()
        for rule in range(3):
            for r in pool:
                if len(picked) < 9 and r not in picked and (rule == 2 or (rule == 0 and r[2:4] not in kinds) or (rule == 1 and r[4] not in anchors)):
                    picked.append(r)
                    kinds.add(r[2:4])
                    anchors.add(r[4])
        want += [(s, n + 1, r[1]) for n, r in enumerate(picked)]
    assert got == sorted(want)
