"""Linked splits, quota samples and cross-split overlaps against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evalloom.llm.linked_splits import ComponentTable, components, linked_blocks, reissue_base, shared_object_tags
from evalloom.llm.overlap import numbered, overlap_pairs, parse_metres, similar_sets
from evalloom.llm.quota_sample import quota_sample, repair


def blocks_of(pairs):
    """Union-find by hand: {record: smallest record of its block}."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r, h in pairs:
        if h is not None:
            up[top(("r", r))] = top(("h", h))
        else:
            top(("r", r))
    found = defaultdict(list)
    for r in {r for r, _ in pairs}:
        found[top(("r", r))].append(r)
    return {r: min(rs) for rs in found.values() for r in rs}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "record string, hub string")


def test_components_of_a_long_chain(spark):
    n = 600
    ids = [f"n{i:04d}" for i in range(n)]
    random.Random(5).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (ids[0], ids[0]), (ids[1], ids[0])], "u string, v string")
    got = components(edges).collect()
    assert len(got) == n and {r["root"] for r in got} == {"n0000"}
    assert components(edges.where("false")).count() == 0


def test_linked_blocks(spark):
    rng = random.Random(6)
    pairs = [(f"g{rng.randint(0, 150):03d}", f"1 s{rng.randint(0, 90)}") for _ in range(170)] + [(f"g{rng.randint(0, 170):03d}", f"2 t{rng.randint(0, 60)}") for _ in range(60)]
    pairs += [(f"g{i:03d}", None) for i in range(160, 180)] + [(f"hot{i}", "1 hot") for i in range(200)] + pairs[:30]
    got = {r["record"]: r["block"] for r in linked_blocks(frame(spark, pairs)).collect()}
    assert got == blocks_of(pairs)
    assert linked_blocks(frame(spark, [])).count() == 0
    assert [tuple(r) for r in linked_blocks(frame(spark, [("a", None), (None, "1 x")])).collect()] == [("a", "a")]


def present(known):
    return {r["record"]: r["block"] for r in known.blocks().collect()}


def test_three_runs_equal_one(spark, tmp_path):
    rng = random.Random(8)
    pairs = [(f"g{rng.randint(0, 199):03d}", f"1 s{rng.randint(0, 90)}") for _ in range(150)] + [(f"g{rng.randint(0, 199):03d}", f"2 t{rng.randint(0, 70)}") for _ in range(90)]
    pairs += [("hot0", "3 h"), ("hot1", "3 h"), ("aaa", "3 h"), ("g900", None)]
    known = ComponentTable(spark, f"{tmp_path}/table")
    for i in range(4):  # records come again with further hubs; the last run brings nothing new
        known.extend(frame(spark, [p for j, p in enumerate(pairs) if j % 3 == i] or pairs[:9]))
        seen = [p for j, p in enumerate(pairs) if j % 3 <= i]
        assert present(known) == blocks_of(seen)
    assert known.runs() == 4 and present(ComponentTable(spark, f"{tmp_path}/table")) == blocks_of(pairs)


def test_later_runs_know_merged_blocks(spark, tmp_path):
    """A third run that comes by a hub of a block which the second run merged away, and by one that the second run brought."""
    known = ComponentTable(spark, f"{tmp_path}/table")
    runs = [[("b", "h1"), ("c", "h2")], [("a", "h1"), ("a", "h3")], [("d", "h2"), ("e", "h1"), ("f", "h3")], [("c", "h9"), ("g", "h1"), ("f", "h9")]]
    done = []
    for rows in runs:
        known.extend(frame(spark, rows))
        done += rows
        assert present(known) == blocks_of(done)
    assert set(present(known).values()) == {"a"}


def test_a_lost_run_is_written_over(spark, tmp_path):
    known = ComponentTable(spark, f"{tmp_path}/table")
    known.extend(frame(spark, [("b", "h1")]))
    known.extend(frame(spark, [("a", "h1"), ("z", "h1")]))
    (tmp_path / "table" / "runs" / "1" / "_SUCCESS").unlink()  # as if the second run had been lost before its end
    assert known.runs() == 1 and present(known) == {"b": "b"}
    known.extend(frame(spark, [("c", "h1")]))
    assert present(known) == {"b": "b", "c": "b"}


TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def test_splits_fill_targets(spark, tmp_path):
    rows = [(f"r{i}", f"b{i // 3}") for i in range(6000)] + [(f"big{i}", "bigblock") for i in range(2500)]
    known = ComponentTable(spark, f"{tmp_path}/table")
    known.extend(frame(spark, rows), TARGETS)
    out = known.splits().collect()
    count = Counter(r["split"] for r in out)
    assert len(out) == len(rows) and abs(count["train"] / len(rows) - 0.8) < 0.01 and abs(count["test"] / len(rows) - 0.1) < 0.01
    by = defaultdict(set)
    for r in out:
        by[r["block"]].add(r["split"])
    assert all(len(s) == 1 for s in by.values()) and by["big0"] == {"train"} and {r["status"] for r in out} == {"new"}


def test_few_records_meet_their_shares(spark, tmp_path):
    sizes = [103, 60, 40, 33] + [5] * 60 + [1] * 467
    rows = [(f"r{b}.{i}", f"b{b}") for b, n in enumerate(sizes) for i in range(n)]
    known = ComponentTable(spark, f"{tmp_path}/table")
    known.extend(frame(spark, rows), TARGETS)
    count = Counter(r["split"] for r in known.splits().collect())
    assert all(abs(count[k] - v * len(rows)) <= 1 for k, v in TARGETS.items())


def test_kept_and_quarantined(spark, tmp_path):
    known = ComponentTable(spark, f"{tmp_path}/table")
    known.extend(frame(spark, [(f"r{i:02d}", f"h{i}") for i in range(40)]), {"train": 0.5, "test": 0.5})
    first = {r["record"]: r["split"] for r in known.splits().collect()}
    train, test = sorted(r for r, s in first.items() if s == "train"), sorted(r for r, s in first.items() if s == "test")
    hub = lambda r: f"h{int(r[1:])}"
    # joins one block; ties two of one split; ties two splits; is new
    late = [("x1", hub(test[0])), ("x2", hub(train[0])), ("x2", hub(train[1])), ("x3", hub(train[2])), ("x3", hub(test[2])), ("x4", "h99"), (None, "h1")]
    known.extend(frame(spark, late), {"train": 0.5, "test": 0.5}, quarantine="train")
    got = {r["record"]: (r["split"], r["status"]) for r in known.splits().collect()}
    assert len(got) == 44 and got["x1"] == got[test[0]] == ("test", "kept") and got["x2"] == got[train[1]] == ("train", "kept")
    assert got["x3"] == got[test[2]] == got[train[2]] == ("train", "quarantined") and got["x4"] == ("test", "new")
    assert all(got[r] == (s, "kept") for r, s in first.items() if r not in (test[2], train[2]))
    # what is quarantined stays so; a split that is no target any more is quarantined when something joins it
    known.extend(frame(spark, [("x5", hub(test[2])), ("x6", hub(test[5]))]), {"train": 1.0})
    got = {r["record"]: (r["split"], r["status"]) for r in known.splits().collect()}
    assert got["x5"] == got[train[2]] == ("train", "quarantined") and got["x6"] == got[test[5]] == ("train", "quarantined") and got[test[6]] == ("test", "kept")


def test_component_table_edges(spark, tmp_path):
    known = ComponentTable(spark, f"{tmp_path}/table")
    assert known.runs() == 0 and known.blocks().count() == 0
    known.extend(frame(spark, []), TARGETS)
    known.extend(frame(spark, [("a", None), ("a", None), (None, "h")]), TARGETS)
    assert [tuple(r)[:2] for r in known.splits().collect()] == [("a", "a")] and known.runs() == 2
    with pytest.raises(ValueError):
        known.extend(frame(spark, [("b", None)]), {})


def test_tags_and_bases(spark):
    ids = ["bookcase_0a1B2c3D", "x#12345678", "x-deadbeef", "sideboard_12", "Hamper|-01.13|+03.38|-03.56", "deadbeef", "xdeadbeef", None]
    got = spark.createDataFrame([(ids,)], "i array<string>").select(shared_object_tags(F.col("i"))).head()[0]
    assert [x for x in got if x] == ["0a1b2c3d", "12345678", "deadbeef", "deadbeef"]
    groups = ["thor_x_00000012", "thor_x_00000012_again2", "thor_x_00000012.v2", "thor_x_00000012-re2", "odd", "thor_0p4_00000012_r2"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in groups], "g string").select(reissue_base(F.col("g"))).collect()]
    assert got == ["thor_x_00000012"] * 4 + ["odd", "thor_0p4_00000012"]


def test_repair_reaches_targets():
    counts = {(a, b): n for a, x in (("p", 500), ("q", 300), ("r", 10)) for b, n in (("u", x), ("v", x // 5), (None, x // 10))}
    targets = {(0, "p"): (0.4, 2), (0, "q"): (0.5, 2), (0, "r"): (0.1, 20), (1, "u"): (0.5, 2), (1, "v"): (0.5, 2)}
    take = repair(counts, targets, 160)
    total = lambda axis, c: sum(n for s, n in take.items() if s[axis] == c)
    assert sum(take.values()) == 160 and all(0 <= n <= counts[s] for s, n in take.items())
    assert total(0, "r") == 13 and abs(total(1, "v") - 80) <= 6 and abs(total(0, "p") - total(0, "q")) <= 30  # r: all there are
    assert repair({}, targets, 10) == {} and sum(repair(counts, {}, 10**9).values()) == sum(counts.values())


def exchange_gain(counts, targets, take, i, j, size):
    """Fall of the total cost when one row of signature i is exchanged for one of j, counted from scratch."""

    def cost(t):
        total = 0.0
        for (a, c), (share, least) in targets.items():
            n = sum(x for s, x in t.items() if s[a] == c)
            total += (n - share * size) ** 2 + 1e6 * size * max(0, least - n)
        return total

    moved = Counter(take)
    moved[i] -= 1
    moved[j] += 1
    return cost(take) - cost(moved)


def test_repair_ends_where_no_exchange_helps():
    rng = random.Random(21)
    for trial in range(12):
        counts = {(a, b, c): rng.randint(1, 40) for a in "pqr" for b in ["u", "v", "w", None] for c in ["x", "y"] if rng.random() < 0.8}
        targets = {(0, "p"): (0.5, 3), (0, "q"): (0.4, 9), (0, "r"): (0.1, 2), (1, "u"): (0.2, 30), (1, "v"): (0.7, 1), (2, "x"): (0.9, 0), (2, "y"): (0.1, 5)}
        size = rng.randint(40, 200)
        take = repair(counts, targets, size, seed=trial)
        size = min(size, sum(counts.values()))
        assert sum(take.values()) == size
        for i in take:
            for j in counts:
                if i != j and take.get(j, 0) < counts[j]:
                    assert exchange_gain(counts, targets, take, i, j, size) <= 1e-6
    starts = {tuple(sorted(repair(dict.fromkeys([("a",), ("b",)], 50), {}, 30, seed=k).items())) for k in range(8)}
    assert len(starts) > 1  # the start is random


def test_report_names_joint_misses(spark):
    # Enough rows of each category, but all of p are u, so p and v cannot both be met.
    df = spark.createDataFrame([(i, "p", "u") for i in range(50)] + [(50 + i, "q", "v") for i in range(50)] + [(200, "other", "u")], "g int, a string, b string")
    _, report = quota_sample(df, "g", ["a", "b"], {("a", "p"): (0.8, 0), ("a", "q"): (0.2, 0), ("b", "v"): (0.8, 0), ("b", "u"): (0.2, 0)}, 40)
    causes = {r[1]: r[8] for r in report}
    assert causes["p"] == causes["v"] == "joint" and {r[7] for r in report if r[1] in "pv"} == {True}
    assert "available" not in causes.values()


def test_quota_sample(spark):
    rng = random.Random(9)
    rows = [(f"g{i}", rng.choice("ab" if i % 7 else "c"), rng.choice(["x", "x", "x", "y", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, a string, b string").withColumn("_b", F.lit(1))
    targets = {("a", "a"): (0.2, 2), ("a", "b"): (0.7, 2), ("a", "c"): (0.1, 2), ("b", "x"): (0.3, 1), ("b", "y"): (0.7, 1), ("b", "z"): (0.0, 3)}
    sample, report = quota_sample(df, "g", ["a", "b"], targets, 300)
    got = sample.collect()
    assert len(got) == len({r["g"] for r in got}) == 300
    by = {(a, c): (there, needed, sampled, cause) for a, c, _, _, there, needed, sampled, _, cause in report}
    assert by["b", "z"] == (0, 3.0, 0, "available") and by["a", "a"][3] in (None, "rounding")
    for (axis, c), (_, needed, sampled, _) in by.items():
        assert sampled == sum(r[axis] == c for r in got)
        if c != "z":
            assert abs(sampled - needed) <= 3
    assert {r["g"] for r in got} == {r["g"] for r in quota_sample(df.repartition(6), "g", ["a", "b"], targets, 300)[0].collect()}
    assert quota_sample(df.where("false"), "g", ["a", "b"], targets, 0)[0].count() == 0


def test_metres(spark):
    texts = ["1.2", "1,2", "~1.2 metres", "120 cm", "1200mm", "1.2 m", "1.2000000001", "", None, "none", "700mm"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_metres(F.col("t"))).collect()]
    assert got[:7] == [pytest.approx(1.2)] * 7 and got[7:] == [None, None, None, pytest.approx(0.7)]


def test_overlap_pairs(spark):
    rng = random.Random(10)
    rows = []
    for i in range(500):
        tokens = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 2, 3]))]
        rows.append((f"r{i:03d}", rng.random() < 0.3, rng.choice(["s", "s", "t", None]), rng.choice([tokens, tokens, [], None]), rng.choice([round(rng.uniform(0, 2), 2), round(rng.uniform(-0.3, 0.3), 2), None, float("nan")])))
    rows += [("e", True, "s", ["q"], 1.25), ("f", False, "s", ["q"], 1.1), ("g", False, "s", ["q"], 1.11)]
    df = spark.createDataFrame(rows, "i string, ev boolean, p string, w array<string>, v double").withColumn("_s", F.lit(0))
    got = [(r["eval_id"], r["train_id"]) for r in overlap_pairs(df, "i", "ev", F.col("p"), "w", "v", 0.15, ["ev"]).collect()]
    clean = [r for r in rows if r[2] is not None and r[3] and r[4] is not None and r[4] == r[4]]
    expected = {(a[0], b[0]) for a in clean if a[1] for b in clean if not b[1] and a[2] == b[2] and sorted(a[3]) == sorted(b[3]) and round(abs(a[4] - b[4]), 9) < 0.15}
    assert len(got) == len(set(got)) and set(got) == expected and ("e", "g") in expected and ("e", "f") not in expected
    assert overlap_pairs(df.where("false"), "i", "ev", F.col("p"), "w", "v", 0.15).count() == 0


def multiset_similarity(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


@pytest.mark.parametrize("share", [0.3, 0.5, 0.6, 0.8, 1.0])
def test_similar_sets_lose_no_pair(spark, share):
    rng = random.Random(int(share * 100))
    make = lambda n: {(rng.choice("pq"), tuple(sorted({rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))}))) for _ in range(n)}
    left, right = make(60), make(120)
    frame_of = lambda rows: spark.createDataFrame([(p, list(s)) for p, s in rows], "place string, set array<string>")
    got = [(r["place"], tuple(r["a"]), tuple(r["b"])) for r in similar_sets(frame_of(left), frame_of(right), share).collect()]
    want = {(p, a, b) for p, a in left for q, b in right if p == q and len(set(a) & set(b)) / len(set(a) | set(b)) >= share - 1e-9}
    assert len(got) == len(set(got)) and set(got) == want and want
    with pytest.raises(ValueError):
        similar_sets(frame_of(left), frame_of(right), 0.0)


def test_overlaps_below_equality(spark):
    rng = random.Random(31)
    rows = [(f"r{i:03d}", rng.random() < 0.4, rng.choice(["s", "s", "t"]), [rng.choice("abc") for _ in range(rng.randint(1, 4))] + rng.choice([[], [None]]), round(rng.uniform(0, 1), 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "i string, ev boolean, p string, w array<string>, v double")
    got = [(r["eval_id"], r["train_id"]) for r in overlap_pairs(df, "i", "ev", F.col("p"), "w", "v", 0.2, share=0.5).collect()]
    clean = [(i, e, p, [t for t in w if t], v) for i, e, p, w, v in rows]
    want = {(a[0], b[0]) for a in clean if a[1] for b in clean if not b[1] and a[2] == b[2] and multiset_similarity(a[3], b[3]) >= 0.5 and round(abs(a[4] - b[4]), 9) < 0.2}
    assert len(got) == len(set(got)) and set(got) == want and any(sorted(a[3]) != sorted(b[3]) for a in clean for b in clean if (a[0], b[0]) in want)


def test_numbered_tokens(spark):
    got = spark.createDataFrame([(["b", "a", "b", "b"],)], "w array<string>").select(numbered(F.col("w"))).head()[0]
    assert [t.replace("\x1f", "#") for t in got] == ["a#0", "b#0", "b#1", "b#2"]
