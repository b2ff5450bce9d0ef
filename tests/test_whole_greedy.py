"""Greedy selections over all candidates, against the plain loops over lists."""

import os
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from evalloom.operators import greedy

DATA = "/root/testdata/sf0.01"


def plain_balanced(rows, k, scene_cap, label_cap):
    rows, scenes, labels, out = sorted(rows, key=lambda r: str(r[0])), Counter(), Counter(), []
    for by_scene, by_label in ((True, True), (False, True), (False, False)):
        while len(out) < k:
            still = [r for r in rows if (not by_scene or scenes[r[1]] < scene_cap) and (not by_label or labels[r[2]] < label_cap)]
            if not still:
                break
            best = min(still, key=lambda r: (labels[r[2]], scenes[r[1]]))
            rows.remove(best)
            scenes[best[1]] += 1
            labels[best[2]] += 1
            out.append(best[0])
    return out


def plain_novelty(rows, k):
    rows, scenes, known, rooms, out = sorted(rows, key=lambda r: str(r[0])), set(), set(), set(), []
    while rows and len(out) < k:
        best = max(rows, key=lambda r: 1000 * (r[1] not in scenes) + 50 * len(set(r[2] or []) - known) + 10 * (r[3] not in rooms))
        rows.remove(best)
        scenes.add(best[1])
        known |= set(best[2] or [])
        rooms.add(best[3])
        out.append(best[0])
    return out


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_lazy_picks_are_those_of_the_plain_loop(spark, most):
    rng = random.Random(most)
    rows = [(i, rng.choice(["s1", "s2", "s3", "s4", None]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "i bigint, s string, l string")
    assert greedy.balanced_under_caps(df, "i", "s", "l", 20, 3, 4, most=most) == plain_balanced(rows, 20, 3, 4)
    words = [(i, s, rng.choice([None, rng.choices(["u", "v", "w", "x", None], k=3)]), l) for i, s, l in rows]
    df = spark.createDataFrame(words, "i bigint, s string, w array<string>, l string")
    assert greedy.novelty_pick(df, "i", "s", "w", "l", 15, most=most) == plain_novelty(words, 15)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_queries_choose_from_all_parts(spark):
    parts = [tuple(r) for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_name").collect()]
    picked = lambda name: [r["p_partkey"] for r in entry.queries()[name](spark, DATA).orderBy("position").collect()]
    assert picked("greedy_balanced") == plain_balanced([p[:3] for p in parts], 150, 5, 30)
    assert picked("greedy_novelty") == plain_novelty([(k, b, n.split(" "), t) for k, b, t, n in parts], 60)
