"""Caps, varied subsets and stable samples against brute force, with nulls, ties, repeats, empty tables and clashing column names."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalloom.llm.capping import cap_per_contributor
from evalloom.llm.common import budget_cuts, current_delivery, label_keys, nearest_category, scene_key, unit_hash
from evalloom.llm.stable import load_thresholds, raise_thresholds, salted_position, save_thresholds, stable_sample
from evalloom.llm.variety import density_weighted, varied_subset


def records(n=400, seed=1):
    rng = random.Random(seed)
    scores = [None, float("nan"), 0.0, -1.0, 1.0, 2.0]
    return [(f"c{i:03d}", rng.choice(["hot"] * 4 + ["a", "b", None]), rng.choice([*scores, rng.random() * 9])) for i in range(n)]


def frame(spark, rows):
    # Extra columns carry names that the operator uses itself.
    df = spark.createDataFrame(rows, "clip string, scene string, score double")
    return df.withColumn("_c", F.lit(1)).withColumn("_salt", F.lit("x")).withColumn("kept", F.lit(None).cast("int"))


def best_first(rows, scene):
    blank = lambda v: v is None or math.isnan(v)
    return sorted((r for r in rows if r[1] == scene), key=lambda r: (blank(r[2]), 0 if blank(r[2]) else -r[2], r[0]))


@pytest.mark.parametrize("cap", [1, 7, 60, 10_000])
def test_best_kept(spark, cap):
    rows = records()
    got = {r["clip"]: r["kept"] for r in cap_per_contributor(frame(spark, rows), "clip", "scene", "score", cap, best=True).collect()}
    expected = {r[0]: True for r in rows}
    for scene in ("hot", "a", "b"):
        expected |= {r[0]: i < cap for i, r in enumerate(best_first(rows, scene))}
    assert got == expected


def test_close_scores_are_settled(spark):
    # Scores nearer to each other than the noise of a cold key, so that keys alone would keep wrong rows.
    rng = random.Random(12)
    rows = [(f"c{i:04d}", "s", 5.0 + rng.randrange(400) * 1e-6) for i in range(3000)] + [(f"d{i}", "t", 2.0) for i in range(300)]
    got = {r["clip"] for r in cap_per_contributor(frame(spark, rows), "clip", "scene", "score", 250, best=True).where("kept").collect()}
    assert got == {r[0] for s in "st" for r in best_first(rows, s)[:250]}
    by_key = cap_per_contributor(frame(spark, rows), "clip", "scene", "score", 250, temperature=1e-4).where("kept").collect()
    assert {r["clip"] for r in by_key} != got  # the settling step matters
    with pytest.raises(ValueError):
        cap_per_contributor(frame(spark, rows), "clip", "scene", "score", 250, temperature=0)


def test_reservoir_is_weighted_and_repeatable(spark):
    rows = [(f"c{i:04d}", "s", 10.0 if i % 2 else 1.0) for i in range(4000)]
    df = frame(spark, rows)
    one = {r["clip"] for r in cap_per_contributor(df, "clip", "scene", "score", 300).where("kept").collect()}
    two = {r["clip"] for r in cap_per_contributor(df.repartition(7, "score"), "clip", "scene", "score", 300).where("kept").collect()}
    heavy = sum(int(c[1:]) % 2 for c in one)
    assert one == two and len(one) == 300 and 0.84 < heavy / 300 < 0.97  # 10 : 1 gives about 0.91
    zero = [("z", "s", 0.0), ("n", "s", -5.0), ("p", "s", 0.1), ("b", "s", None)]
    assert [r["clip"] for r in cap_per_contributor(frame(spark, zero), "clip", "scene", "score", 1).where("kept").collect()] == ["p"]


def test_cap_edges(spark):
    assert cap_per_contributor(frame(spark, []), "clip", "scene", "score", 3).count() == 0
    with pytest.raises(ValueError):
        cap_per_contributor(frame(spark, records(3)), "clip", "scene", "score", 0)


def test_keys(spark):
    scenes = ["0457_981203", "scene_0457_981203", "InteriorGS/0457_981203", "457-981203", " 0457__981203", "FloorPlan50001", "Floor Plan 50001", "thor/FloorPlan50001", "Attic", "  ", None, "0"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in scenes], "s string").select(scene_key(F.col("s"))).collect()]
    assert got == ["457_981203"] * 5 + ["50001"] * 3 + ["attic", None, None, "0"]
    labels = [["Tall Oak-Bed|1", "rug"], ["rug", "tall_oak_bed"], ["", None], [], None, ["RUG", "rug"]]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l array<string>").select(label_keys(F.col("l"))).collect()]
    assert got == [["rug", "talloakbed"]] * 2 + [None, None, None, ["rug", "rug"]]
    words = ["Living Room.", "livng_room", "LIVINGROOM", "bdroom", "kittchen", "garage", "", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(nearest_category(F.col("w"), ["living_room", "bedroom", "bathroom", "kitchen"])).collect()]
    assert got == ["living_room", "living_room", "living_room", "bedroom", "kitchen", None, None, None]


def test_current_delivery(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "only"), (None, 9, "lost"), ("c", 3, "x"), ("c", 3, "y")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    one = {r["k"]: r["v"] for r in current_delivery(df, "k", "at", ["v"]).collect()}
    two = {r["k"]: r["v"] for r in current_delivery(df.orderBy(F.desc("v")), "k", "at", ["v"]).collect()}
    assert one == two and one["a"] == "new" and one["b"] == "only" and set(one) == {"a", "b", "c"}


def test_budget(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcd"), rng.choice([rng.random() ** 4, 0.25]), rng.randint(1, 9)) for i in range(900)] + [(1000, None, 0.1, 1), (1001, "a", 0.0, None)]
    budgets = {"a": 300, "b": 0, "c": 10**9, "x": 5, "d": 1}
    df = spark.createDataFrame(rows, "i int, k string, p double, n int")
    plan = spark.createDataFrame(list(budgets.items()), "k string, budget bigint")
    got = {r["k"]: (r["taken"], r["last"]) for r in budget_cuts(df, "k", "p", F.col("n"), "i", plan, 5).collect()}
    for k, budget in budgets.items():
        run, last = 0, None
        for r in sorted((r for r in rows if r[1] == k and r[3]), key=lambda r: (r[2], r[0])):
            if run + r[3] > budget:
                break
            run, last = run + r[3], (r[2], r[0])
        if k == "x":
            assert k not in got
        else:
            assert got[k][0] == run and (got[k][1] and tuple(got[k][1])) == last
    assert budget_cuts(df.where("false"), "k", "p", F.col("n"), "i", plan, 5).count() == 0


def variety(size, df):
    turn = F.radians(F.col("angle").cast("double"))
    features = [(F.col("family") == "x").cast("double") * 4, F.cos(turn), F.sin(turn)]
    return varied_subset(df, size=size, ident="i", setting=["family", "angle"], features=features)


def test_varied_subset(spark):
    rows = [(i, "x", 0) for i in range(3000)] + [(3000 + i, "y", 90 * (i % 4)) for i in range(40)] + [(9000, None, None)]
    df = spark.createDataFrame(rows, "i int, family string, angle int").withColumn("density", F.lit("clash"))
    df = df.withColumn("angle", F.coalesce("angle", F.lit(0))).withColumn("family", F.coalesce("family", F.lit("none")))
    got = variety(60, df).collect()
    kinds = Counter(r["family"] for r in got)
    assert len(got) == 60 and kinds["y"] >= 30  # of 40 there are; by rows alone x would have 59 of the 60
    assert {r["i"] for r in got} == {r["i"] for r in variety(60, df.repartition(5)).collect()}
    assert variety(10**6, df).count() == len(rows) and variety(5, df.where("false")).count() == 0


def test_density_counts_buckets(spark):
    df = spark.createDataFrame([(i, float(i // 50)) for i in range(100)], "i int, v double")
    got = density_weighted(df, "i", ["v"], [F.col("v") * 1e6], size=10)
    assert {r["density"] for r in got.collect()} == {50.0}
    same = density_weighted(df, "i", ["v"], [F.col("v") * 1e-9], size=10)
    assert {r["density"] for r in same.collect()} == {100.0}


def test_stable_sample_grows_only(spark):
    df = spark.range(5000).select(F.concat(F.lit("c"), F.col("id")).alias("c"), (F.col("id") % 3).cast("string").alias("s"), F.lit(1).alias("ident"))
    first = raise_thresholds({}, default=0.1)
    early = {r["ident"] for r in stable_sample(df.where("c < 'c5'"), "c", F.col("s"), first).collect()}
    all_now = {r["ident"] for r in stable_sample(df.union(df).repartition(3), "c", F.col("s"), first).collect()}
    assert early <= all_now and 420 < len(all_now) < 580
    second = raise_thresholds({"1": 0.5, "2": 0.01}, first, default=0.05)
    assert second == {"": 0.1, "1": 0.5, "2": 0.1}
    more = {r["ident"] for r in stable_sample(df, "c", F.col("s"), second).collect()}
    assert all_now <= more and len(more) > len(all_now) + 500
    nulls = spark.createDataFrame([(None, None), ("a", None)], "c string, s string")
    assert [tuple(r) for r in stable_sample(nulls, "c", F.col("s"), {"": 1.0}).collect()] == [("a", "")]
    assert stable_sample(df.where("false"), "c", F.col("s"), first).count() == 0
    with pytest.raises(ValueError):
        raise_thresholds({"a": 1.5})
    assert raise_thresholds({"a": 0.2}, {"a": 0.4, "b": 0.3}) == {"a": 0.4, "b": 0.3}


def test_hashes(spark):
    import hashlib

    u = [r[0] for r in spark.range(4000).select(unit_hash(F.col("id"), salt="t")).collect()]
    assert all(0 < x < 1 for x in u) and abs(sum(u) / 4000 - 0.5) < 0.03
    p = spark.range(1).select(salted_position(F.lit("abc"), "s")).head()[0]
    assert p == int(hashlib.md5(b"s:abc").hexdigest()[:12], 16)


def test_thresholds_are_kept_between_runs(spark, tmp_path):
    save_thresholds(spark, {"": 0.1, "a": 0.3}, f"{tmp_path}/one")
    assert load_thresholds(spark, f"{tmp_path}/one") == {"": 0.1, "a": 0.3}
    assert raise_thresholds({"a": 0.2, "b": 0.5}, load_thresholds(spark, f"{tmp_path}/one")) == {"": 0.1, "a": 0.3, "b": 0.5}
    df = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("c"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("s"))
    got = Counter(r["stratum"] for r in stable_sample(df, "c", F.col("s"), {"a": 0.5, "b": 0.0}).collect())
    assert 430 < got["a"] < 570 and got["b"] == got[""] == 0
