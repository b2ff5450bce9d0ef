"""Leak-free splits that serve both sides, against the plain loop."""

import random

import pytest

from evalloom.operators import splits


def plain_split(sizes, need, train_need):
    items, held, total = [], 0, sum(sizes.values())
    for k in sorted(sizes, key=lambda k: (sizes[k], k)):
        if held >= need:
            break
        items.append(k)
        held += sizes[k]
    while total - held < train_need:
        movable = [k for k in items if held - sizes[k] >= need]
        if not movable:
            return None
        k = min(movable, key=lambda k: (sizes[k], k))
        items.remove(k)
        held -= sizes[k]
    return set(items)


def test_train_gets_its_need(spark):
    rng = random.Random(15)
    sizes = {k: rng.randint(1, 4) for k in range(20)} | {50: 30, 51: 40}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "k int")
    small, total = sum(sizes.values()) - 70, sum(sizes.values())
    for need, train_need in ((small + 5, 41), (small + 5, 52), (small + 5, total - small - 10), (10, 40)):
        expected = plain_split(sizes, need, train_need)
        if expected is None:
            with pytest.raises(ValueError, match="no split"):
                splits.leak_free(df, ["k"], need, train_need)
        else:
            got = splits.leak_free(df, ["k"], need, train_need).collect()
            assert {r["k"] for r in got if r["split"] == "eval"} == expected
            assert sum(r["n"] for r in got if r["split"] == "train") >= train_need
    assert plain_split(sizes, small + 5, 52) is not None
    with pytest.raises(ValueError, match="no split"):
        splits.leak_free(df, ["k"], total, 1)
