"""Reshaping, geometry, text, readers, writers, hooks and streams on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions import arrays, frames, geometry, text
from evalloom.operators import breakdown, reshape
from evalloom.plans import config, hooks
from evalloom.sources import readers, writers
from evalloom.streaming import live


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()[0]


def test_flatten_and_nest(spark):
    df = spark.createDataFrame([(1, [("q1", 2.0), ("q2", None)]), (2, []), (3, None)], "i int, qs array<struct<q:string,v:double>>")
    flat = reshape.flatten(df, ["i"], "qs")
    assert flat.count() == 2 and reshape.flatten(df, ["i"], "qs", outer=True).count() == 4
    back = reshape.nest(flat, ["i"], "q", ["q", "v"], "qs").head()
    assert [tuple(x) for x in back["qs"]] == [("q1", 2.0), ("q2", None)]
    parts = reshape.split_vector(spark.createDataFrame([("a", [0.4, 0.3, 0.1])], "i string, v array<double>"), F.col("v"), ["length", "width", "height"], "i")
    assert [(r["i"], r["dimension"], r["value"]) for r in parts.collect()] == [("a__dim_length", "length", 0.4), ("a__dim_width", "width", 0.3), ("a__dim_height", "height", 0.1)]


def test_keys_and_routes(spark):
    assert one(spark, reshape.label_key(F.array(F.lit("B |1"), F.lit(""), F.lit("A"), F.lit("C")))) == "A–B"
    assert one(spark, reshape.atomic_labels(F.array(F.lit("b"), F.lit("a|x"), F.lit("b")))) == ["a", "b"]
    assert one(spark, reshape.remap_prefix(F.lit("/old/a/old/b"), "/old", "/new")) == "/new/a/old/b"
    assert one(spark, reshape.replace_first(F.lit("a-b-c"), "-", "+")) == "a+b-c" and one(spark, reshape.replace_first(F.lit("abc"), "-", "+")) == "abc"
    assert one(spark, reshape.path_part(F.lit("/x/FloorPlan1/y"), "FloorPlan")) == "FloorPlan1" and one(spark, reshape.path_part(F.lit("/x"), "FloorPlan")) is None
    assert one(spark, reshape.decimal_tag(F.lit(1.5))) == "1p5" and one(spark, reshape.decimal_tag(F.lit(None).cast("double"))) is None
    with pytest.raises(Exception, match="no branch"):
        one(spark, reshape.route(F.lit("zz"), {"a": F.lit(1)}))
    merged = one(spark, reshape.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9))))
    assert merged == {"a": 1, "b": 9}
    assert [one(spark, breakdown.flat_metric_parts(F.lit(k))["metric"]) for k in ("qtype:size_n_groups", "overall_n", "engine:thor_mean_CV", "other")] == ["n_groups", "n", "mean_CV", None]


def test_text(spark):
    tag = one(spark, text.variation_parts(F.lit("2x_start90")))
    assert tuple(tag) == (2, "start", 90) and tuple(one(spark, text.variation_parts(F.lit("x")))) == (None, None, None)
    assert one(spark, text.for_image(F.lit("Seen IN THIS VIDEO now"))) == "Seen in this image now" and one(spark, text.for_image(F.lit("IN THIS VIDEO"), exact=True)) == "IN THIS VIDEO"
    assert one(spark, text.compose_prompt(F.lit(" q "), "before", "")) == "before q" and one(spark, text.shortened(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.before_marker(F.lit("ask [Output] rest"))) == "ask" and one(spark, text.key_values(F.lit("a=1,b=2"))) == {"a": "1", "b": "2"}
    assert [one(spark, text.room_of_number(F.lit(n))) for n in (1, 215, 330, 401, 99)] == ["kitchen", "living_room", "bedroom", "bathroom", "other"]
    assert [one(spark, text.engine_of(F.lit(a).cast("string"), F.lit(b))) for a, b in (("THOR ", "x"), (None, "FloorPlan1"), ("", "0457_981203"), (None, "?"))] == ["thor", "thor", "interiorgs", None]


def test_arrays(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, arrays.subset(a(), a("x"))) and not one(spark, arrays.subset(a("y"), a("x"))) and one(spark, arrays.disjoint(a("y"), a("x")))
    assert one(spark, arrays.in_all(F.array(a("x", "y"), a("y"), a("y", "z")))) == ["y"]
    frames = F.create_map(F.lit("f0"), a("x", "y"), F.lit("f1"), a("x"))
    assert one(spark, arrays.covisible_frames(a("x"), frames)) == 2 and one(spark, arrays.covisible_frames(a("x", "y"), frames)) == 1
    assert one(spark, arrays.nested_get(F.create_map(F.lit("a"), F.create_map(F.lit("b"), F.lit(1))), "a", "c")) is None


def test_geometry(spark):
    p = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    box = F.array(*[p(x, y, z) for x in (0, 2) for y in (0, 3) for z in (0, 1)])
    assert tuple(one(spark, geometry.object_size(box))) == (2.0, 1.0, 3.0) and one(spark, geometry.volume(geometry.box_of(box))) == 6.0
    upper = geometry.box_of(F.array(p(0.5, 3.01, 0.2), p(1, 4, 0.8)))
    assert one(spark, geometry.rests_on(geometry.box_of(box), upper)) and not one(spark, geometry.contains(geometry.box_of(box), upper))
    assert one(spark, geometry.heading(F.lit(1.0), F.lit(0.0))) == 90.0 and one(spark, geometry.ratio(F.lit(2.0), F.lit(0.0))) is None
    pixel = one(spark, geometry.project(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), 90.0, 640, 480))
    assert (pixel["u"], pixel["v"], pixel["depth"]) == (320.0, 240.0, 2.0) and one(spark, geometry.project(F.lit(0.0), F.lit(0.0), F.lit(-2.0), F.lit(0.0), F.lit(0.0), 90.0, 640, 480)) is None
    poses = one(spark, geometry.orbit(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), 4))
    assert [round(math.hypot(q["x"], q["z"]), 9) for q in poses] == [2.0] * 4 and [q["yaw"] for q in poses] == [180.0, 270.0, 0.0, 90.0]
    assert one(spark, geometry.distance_buckets(0.4, 0.8, 0.1)) == [0.4, 0.5, 0.6, 0.7, 0.8] and one(spark, geometry.round_up_ties(F.lit(0.25))) == 0.3
    assert len(one(spark, geometry.straight(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), 3))) == 3
    assert one(spark, geometry.all_or_nothing(F.array(F.lit(1), F.lit(5)), lambda x: x < 3)) is None


def test_readers_and_writers(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "arr.json").write_text(json.dumps([{"a": 1, "b": "x", "extra": 9}, {"a": 2}]))
    assert [tuple(r) for r in readers.json_array(spark, str(tmp_path / "arr.json"), schema).collect()] == [(1, "x"), (2, None)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 3, "b": "z"}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), schema, {"_task": "t"}).where("a = 3 and _task = 't'").count() == 1
    assert [r["record"] for r in readers.corrupt_records(spark, str(tmp_path / "l.jsonl"), schema).collect()] == ["broken"]
    (tmp_path / "keyed.jsonl").write_text('{"img1": {"a": 5, "b": "k"}}\n\n{"img2": {"a": 6}}\n')
    assert {r["key"]: r["a"] for r in readers.keyed_lines(spark, str(tmp_path / "keyed.jsonl"), schema).collect()} == {"img1": 5, "img2": 6}
    (tmp_path / "meta.json").write_text(json.dumps({"config": {"a": 4}, "huge": [1, 2]}))
    assert readers.one_key(spark, str(tmp_path / "meta.json"), "config", "a int").head()["config"]["a"] == 4
    index = readers.files(spark, str(tmp_path), "*.json")
    assert index.count() == 2 and readers.latest_per_key(index, F.lit("k")).head()["path"].endswith("meta.json") and readers.first_per_key(index, F.lit("k")).head()["path"].endswith("arr.json")
    assert readers.latest_per_key(index, F.lit("k"), "modified").count() == 1
    assert one(spark, readers.checkpoint_step(F.lit("/m/checkpoint-120/r.json"))) == 120 and one(spark, readers.path_part_from_end(F.lit("/a/b/c"), 2)) == "b" and one(spark, readers.path_part_from_end(F.lit("c"), 3)) is None
    both = readers.union_directories(spark, {"m": [str(tmp_path / "arr.json"), str(tmp_path / "arr.json")]}, lambda s, d: readers.json_array(s, d, schema))
    assert both.count() == 4
    small = spark.createDataFrame([("a|b", 1.234), ("c_d", None)], "name string, v double")
    assert writers.markdown(small).splitlines()[2] == "| a\\|b | 1.23 |" and "c\\_d & --" in writers.latex(small) and writers.tsv(small).splitlines()[2] == "c_d\t"
    writers.write_tsv(small, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2
    groups, clips = spark.createDataFrame([("g",)], "g string"), spark.createDataFrame([("c",)], "c string")
    writers.write_plan(groups, clips, str(tmp_path / "plan"))
    assert [x.count() for x in writers.read_plan(spark, str(tmp_path / "plan"), groups.schema, clips.schema)] == [1, 1]


def test_hooks():
    with pytest.raises(KeyError):
        hooks.resolve("missing hook")
    hooks.hook("test only")(len)
    assert hooks.resolve("test only") is len
    with pytest.raises(ValueError, match="exists"):
        hooks.hook("test only")(len)


def test_stream(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("g", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("t", T.DoubleType())])
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"k": "a", "g": g, "p": float(i + 1), "t": 2.0}) for g in ("x", "y")))
    stream = live.sample_stream(spark, str(tmp_path / "in"), schema, per_trigger=1)
    running = live.running_scores(stream.withColumn("kg", F.concat_ws("/", "k", "g")), "kg", "p", "t").withColumn("k", F.substring_index("kg", "/", 1))
    live.slice_reports(running, "k", "kg", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("batch")).head()
    assert last["n_groups"] == 2 and last["mean_cv"] == pytest.approx(0.5)
    live.append_sink(live.sample_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "copy"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "copy")).count() == 6


def test_identifiers(spark):
    assert [one(spark, text.question_kind(F.lit(q))) for q in ("Distance between A and camera", "distance from A to B", "the distance from the camera", "What WIDTH", "?")] == ["pair_distance", "pair_distance", "camera_distance", "size", "unknown"]
    assert [one(spark, text.scene_edit(F.lit(x))) for x in ("rotate", "remove", "paint")] == ["obj_rotation", "remove", None] and one(spark, text.camera_variation(F.lit("rotation"))) == "cam_rotation"
    assert one(spark, text.motion_in_group_id(F.lit("thor_around_object_dimensions_length_1"))) == "around" and one(spark, text.motion_in_group_id(F.lit("x"))) is None
    assert [one(spark, text.frame_number(F.lit(x))) for x in ("frame_00012", "a/frame_00007.png", "img_1")] == [12, 7, None]
    pair = one(spark, text.pair_in_question_id(F.lit("object_pair_distance_center_Bed|+1.0|-2.5|0.0_Cup|1.0|2.0|3.0")))
    assert tuple(pair) == ("Bed", "Cup") and tuple(one(spark, text.pair_in_question_id(F.lit("x")))) == (None, None)
    assert one(spark, text.cycles_in_tag(F.lit("start90_2x"))) == 2 and one(spark, text.after_last_slash(F.lit("a/b"))) == "b" and one(spark, text.primary_label(F.lit("Bed|1|2"))) == "Bed"
    talk = F.array(F.struct(F.lit("human").alias("from"), F.lit("<video>\n ask ").alias("value")))
    assert one(spark, text.asked(talk)) == "ask"


def test_frames_and_config(spark):
    box = lambda p, a, x, y: one(spark, frames.usable_box(F.lit(p), F.lit(a), F.lit(x), F.lit(y)))
    assert box("passby", 0.002, 0.1, 0.2) and not box("passby", 0.001, 0.5, 0.5) and not box("approach", 0.2, 0.8, 0.5) and box("around", 0.2, 0.9, 0.9) and not box("spherical", 0.2, 0.5, 0.9)
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
    quality = lambda p, d, a, c: one(spark, frames.run_quality(F.lit(p), F.lit(d), a, c))
    assert quality("approach", "fw", arr(0.1, 0.2, 0.3), arr(0.5, 0.5, 0.5)) == pytest.approx(300) and quality("passby", "bw", arr(0.1, 0.1), arr(0.2, 0.8)) == pytest.approx(260)
    assert quality("spherical", "cw", arr(0.1), arr(0.4)) == pytest.approx(190) and quality("around", "cw", arr(), arr()) == 0
    assert config.evenly_chosen((3, 1, 2, 2), 2) == (1, 3) and config.evenly_chosen((1, 2), 5) == (1, 2, 1, 2, 1) and config.evenly_chosen((4,), 1) == (4,)
    assert config.BuildConfig(scenes={"thor": ("a",), "interiorgs": ("b",)}).checked()
    for bad in ({"group_size": 3}, {"engines": ()}, {"engines": ("x",)}, {}):
        with pytest.raises(ValueError):
            config.BuildConfig(**bad).checked()
