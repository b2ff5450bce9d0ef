"""Question generation, plane neighbours, p-values, group rebuilding and schemas."""

import json
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalloom import schemas
from evalloom.operators import consistency, generation, joins, reshape, windows
from evalloom.sources import readers


def test_p_values(spark):
    # Values of the t distribution: r = 0.5 with 10 pairs is t = 1.633 on 8 degrees of freedom.
    assert consistency.correlation_p_value(0.5, 10) == pytest.approx(0.14111, abs=1e-4)
    assert consistency.correlation_p_value(0.9, 5) == pytest.approx(0.03739, abs=1e-4)
    assert consistency.correlation_p_value(-0.5, 10) == consistency.correlation_p_value(0.5, 10)
    assert consistency.correlation_p_value(0.0, 10) == 1.0 and consistency.correlation_p_value(1.0, 10) == 0.0
    assert consistency.correlation_p_value(0.5, 2) is None and consistency.correlation_p_value(None, 9) is None
    df = spark.createDataFrame([(10, 0.5), (2, 0.5), (9, None)], "n int, r double")
    got = [x["p_r"] for x in consistency.with_p_values(df, "n", ["r"]).collect()]
    assert got[0] == pytest.approx(0.14111, abs=1e-4) and got[1:] == [None, None]


def test_nearest_in_plane(spark):
    rng = random.Random(12)
    probes = [(i, rng.uniform(-50, 50), rng.gauss(0, 1)) for i in range(80)] + [(90, None, 1.0)]
    points = [(i, rng.gauss(0, 2), rng.gauss(0, 2)) for i in range(40)] + [(70, 0.0, 0.0), (71, 0.0, 0.0)]
    a, b = spark.createDataFrame(probes, "p int, x double, y double"), spark.createDataFrame(points, "q int, x double, y double")
    got = {r["p"]: r["q"] for r in joins.nearest_in_plane(a, "p", b, "q", ["x", "y"], 0.5).collect()}
    assert got == {p: min((((u - x) ** 2 + (v - y) ** 2) ** 0.5, q) for q, u, v in points)[1] for p, x, y in probes if x is not None}
    assert joins.nearest_in_plane(a, "p", b.where("false"), "q", ["x", "y"], 0.5).count() == 0


def test_frequent_pairs(spark):
    rng = random.Random(13)
    rows = [(rng.randint(0, 30), rng.choice("abcdefg")) for _ in range(120)] + [(None, "a"), (1, None)]
    got = {(r["item_a"], r["item_b"]): r["views"] for r in generation.frequent_pairs(spark.createDataFrame(rows, "v int, i string"), "v", "i", 3).collect()}
    views = {}
    for v, i in rows:
        if v is not None and i is not None:
            views.setdefault(v, set()).add(i)
    count = Counter(p for s in views.values() for p in combinations(sorted(s), 2))
    assert got == {p: n for p, n in count.items() if n >= 3}
    with pytest.raises(Exception, match="too many items"):
        generation.frequent_pairs(spark.createDataFrame([(v, f"i{k}") for v in (1, 2) for k in range(9)], "v int, i string"), "v", "i", 2, most_items=5).collect()


def test_objects_and_questions(spark):
    df = spark.createDataFrame([("s", "Bed", 2.0), ("s", "Cup", 1.0), ("s", "Cup", 1.0), ("s", "Wall", 2.0), ("t", "Bed", 99.0)], "s string, k string, v double")
    assert [tuple(r) for r in generation.usable_objects(df, "s", "k", F.col("v"), 0.5, 5, ["wall"]).collect()] == [("s", "Bed", 2.0)]
    q = generation.size_questions(spark.createDataFrame([(1, "bed", 0.25, None)], "i int, n string, length double, width double"), ["i"], "n", ["length", "width"]).collect()
    assert [tuple(r) for r in q] == [(1, "length", "What is the length of the bed in metres?", 0.3)]
    p = generation.pair_questions(spark.createDataFrame([("s", 1, 0.0), ("s", 2, 1.0), ("s", 3, 5.0)], "s string, i int, v double"), "s", "i", "v", 0.5, 2.0).collect()
    assert [(r["id_a"], r["id_b"], r["answer"]) for r in p] == [(1, 2, 1.0)]


def test_rebuilding(spark):
    df = spark.createDataFrame([("g", 2, "b", "y"), ("g", 1, "a", "x"), (None, 0, "c", "z"), ("h", 5, "d", None)], "g string, o int, i string, v string")
    got = {r["g"]: (r["v"], r["n"], r["members"]) for r in reshape.reconstruct_groups(df, "g", F.col("o"), ["v"], "i").collect()}
    assert got == {"g": ("x", 2, ["a", "b"]), "h": (None, 1, ["d"])}
    top = windows.top_distinct(spark.createDataFrame([("g", "a", 9, 1), ("g", "a", 8, 2), ("g", "b", 1, 3)], "g string, k string, q int, i int"), "g", "k", [F.desc("q"), F.col("i")], 2)
    assert [r["i"] for r in top.orderBy("position").collect()] == [1, 3]


def test_schemas(spark, tmp_path):
    assert StructType.fromDDL(schemas.scored("score"))["score"].dataType["MRA:.5:.95:.05"].dataType.simpleString() == "double"
    record = {"image_id": "i1", "scene_id": "s", "qa_pairs": [{"question": "q", "answer": "[0.4, 0.3, 0.1]", "question_type": "object_size", "question_id": "1", "primary_object": "bed"}]}
    (tmp_path / "qa.jsonl").write_text(json.dumps(record) + "\n")
    flat = reshape.flatten(readers.json_lines(spark, str(tmp_path / "qa.jsonl"), schemas.MULTIVIEW), ["image_id"], "qa_pairs")
    assert flat.head()["answer"] == "[0.4, 0.3, 0.1]"
    sample = {"doc_id": 1, "filtered_resps": ["1.5"], "score": {"clip_id": "c", "MRA": 0.9, "MRA:.5:.95:.05": 0.9, "prediction": "1.5"}}
    (tmp_path / "s.jsonl").write_text(json.dumps(sample) + "\n")
    row = readers.json_lines(spark, str(tmp_path / "s.jsonl"), schemas.scored("score"), {"_task": "t"}).select("doc_id", "_task", "score.*").head()
    assert row["MRA:.5:.95:.05"] == 0.9 and row["clip_id"] == "c"
    for name in ("CLIP", "NESTED_QA", "GROUP", "IMAGE_GROUP", "HIGHER_ORDER", "SCENE_VARIATION", "CANDIDATE", "SCAN", "VISIBILITY", "CONVERSATION", "RESULTS"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0
