"""Pairs of items in views of any size, against plain counts in Python."""

import random
from collections import Counter
from itertools import combinations

from evalloom.operators import generation


def test_pairs_of_a_hot_view_are_counted(spark):
    rng = random.Random(14)
    rows = [(v, i) for v in (1, 2) for i in range(230) if rng.random() < 0.9] + [(rng.randint(3, 60), rng.randint(0, 250)) for _ in range(400)] + [(None, 1), (9, None)]
    views = {}
    for v, i in rows:
        if v is not None and i is not None:
            views.setdefault(v, set()).add(i)
    count = Counter(p for s in views.values() for p in combinations(sorted(s), 2))
    for least in (1, 2, 3):
        got = [tuple(r) for r in generation.frequent_pairs(spark.createDataFrame(rows, "v int, i int"), "v", "i", least).collect()]
        assert len(got) == len(set(got)) and {(a, b): n for a, b, n in got} == {p: n for p, n in count.items() if n >= least}
