"""Queries on files, sinks, streams and checks: tables written in the formats that the readers know and read again, from the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import arrays, frames, geometry, metrics, text
from evalloom.operators import joins
from evalloom.plans.config import BuildConfig
from evalloom.plans.tables import cape_sql, mra_sql, r, table
from evalloom.session import scratch, stored
from evalloom.sources import readers, writers
from evalloom.streaming import live


def directory_union(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of each status in a directory of their own, two of which are one model's; all directories of a name count."""
    base = scratch(spark, "union")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders.write.mode("overwrite").partitionBy("o_orderstatus").json(base)
    read = lambda s, d: readers.json_lines(s, d, "o_orderkey bigint, o_totalprice double")
    out = readers.union_directories(spark, {"open": [f"{base}/o_orderstatus=O"], "rest": [f"{base}/o_orderstatus=F", f"{base}/o_orderstatus=P"]}, read)
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice"), 4).alias("price"))


UNION_SQL = "SELECT CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'rest' END AS model, count(*) AS n, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1"


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Regions written as one document each, with their nations under one key and much else under another; only the first key is read."""
    out = scratch(spark, "documents")
    nations = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    docs = nations.select("n_regionkey", F.to_json(F.struct(F.struct("n_regionkey", "nations").alias("config"), F.array_repeat(F.lit("x"), 50).alias("huge"))).alias("value"))
    docs.repartition(8, "n_regionkey").write.mode("overwrite").partitionBy("n_regionkey").text(out)
    back = readers.one_key(spark, f"{out}/*", "config", "n_regionkey bigint, nations array<string>")
    return back.select(F.col("config.n_regionkey").alias("n_regionkey"), F.concat_ws(",", "config.nations").alias("nations"))


DOCUMENTS_SQL = "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1"


def json_array_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers written as one JSON array a nation and read as records; a field that the schema does not name is dropped."""
    out = scratch(spark, "array")
    rows = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_nationkey", "s_acctbal", F.lit("x").alias("junk")))).alias("value"))
    rows.repartition(8, "s_nationkey").write.mode("overwrite").partitionBy("s_nationkey").text(out)
    back = readers.json_array(spark, f"{out}/*", "s_suppkey bigint, s_nationkey bigint, s_acctbal double, missing string")
    return back.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count("missing").alias("missing"), F.max("s_acctbal").alias("most"))


ARRAY_SQL = "SELECT s_nationkey, count(*) AS n, 0::BIGINT AS missing, max(s_acctbal) AS most FROM supplier GROUP BY 1"


def plan_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A plan, groups and their clips, written and loaded with its schemas, joined again."""
    out = scratch(spark, "plan")
    groups = table(spark, folder, "consistency_groups").select("group_id", "scene_id", "clip_ids").distinct()
    clips = joins.last_wins(table(spark, folder, "clips"), ["clip_id"], "ingested_at", ["group_id", "quality_score"])
    writers.write_plan(groups, clips, out)
    g, c = writers.read_plan(spark, out, "group_id string, scene_id string, clip_ids array<string>", "clip_id string, group_id string, quality_score double")
    per_group = c.groupBy("group_id").agg(F.count(F.lit(1)).alias("clips"))
    return g.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("clip_ids")).cast("bigint").alias("listed")).join(per_group, "group_id", "left").select("group_id", "rows", "listed", F.coalesce("clips", F.lit(0)).alias("clips"))


PLAN_SQL = """
    WITH c AS (SELECT clip_id, group_id FROM clips QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC) = 1), n AS (SELECT group_id, count(*) AS clips FROM c GROUP BY 1),
    g AS (SELECT DISTINCT group_id, scene_id, clip_ids FROM consistency_groups)
    SELECT group_id, count(*) AS rows, max(len(clip_ids)) AS listed, coalesce(any_value(clips), 0) AS clips FROM g LEFT JOIN n USING (group_id) GROUP BY 1
"""


def report_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """Mean balances per segment as the lines of a Markdown, a LaTeX and a TSV table, and the TSV file read again."""
    each = table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 2).alias("mean")).orderBy("c_mktsegment")
    out = scratch(spark, "tsv")
    writers.write_tsv(each, out)
    back = spark.read.option("sep", "\t").option("header", True).schema("c_mktsegment string, n bigint, mean double").csv(out).orderBy("c_mktsegment")
    lines = [(kind, i, line) for kind, page in (("markdown", writers.markdown(each)), ("latex", writers.latex(each)), ("tsv", writers.tsv(each)), ("file", writers.tsv(back))) for i, line in enumerate(page.rstrip("\n").split("\n"))]
    return spark.createDataFrame(lines, "sink string, line bigint, text string")


_SINK = "SELECT row_number() OVER (ORDER BY c_mktsegment) AS i, c_mktsegment AS s, count(*) AS n, round(avg(c_acctbal), 2) AS m FROM customer GROUP BY c_mktsegment"
SINKS_SQL = f"""
    WITH t AS ({_SINK}), k AS (SELECT count(*) AS k FROM t)
    SELECT 'markdown' AS sink, i + 1 AS line, '| ' || s || ' | ' || n || ' | ' || format('{{:.2f}}', m) || ' |' AS text FROM t UNION ALL SELECT 'markdown', 0, '| c_mktsegment | n | mean |' UNION ALL SELECT 'markdown', 1, '|---|---|---|'
    UNION ALL SELECT 'latex', i + 1, s || ' & ' || n || ' & ' || format('{{:.2f}}', m) || ' \\\\' FROM t UNION ALL SELECT 'latex', 0, '\\begin{{tabular}}{{lll}}' UNION ALL SELECT 'latex', 1, 'c\\_mktsegment & n & mean \\\\ \\hline' UNION ALL SELECT 'latex', k + 2, '\\end{{tabular}}' FROM k
    UNION ALL SELECT sink, i, s || chr(9) || n || chr(9) || format('{{:.4f}}', m) FROM t, (SELECT unnest(['tsv', 'file']) AS sink) UNION ALL SELECT sink, 0, 'c_mktsegment' || chr(9) || 'n' || chr(9) || 'mean' FROM (SELECT unnest(['tsv', 'file']) AS sink)
"""


def validated_source(spark: SparkSession, folder: str) -> DataFrame:
    """Clips with a video, checked against the index of videos there are, in a hash order; and group deliveries checked to be unique."""
    clips = table(spark, folder, "clips").where("video_path is not null")
    rows = readers.validated(clips, "video_path", clips.select(F.col("video_path").alias("path")).distinct(), seed=7)
    counts = rows.groupBy("engine").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("video_path").alias("videos"))
    return joins.require_unique(counts, ["engine"])


VALIDATED_SQL = "SELECT engine, count(*) AS n, count(DISTINCT video_path) AS videos FROM clips WHERE video_path IS NOT NULL GROUP BY 1"


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """Results of runs in nested folders: model and step read from the paths, the last run of each by name and by time, the first of each."""
    base = scratch(spark, "runs")
    for model, step in (("m1", 5), ("m1", 20), ("m2", 100)):
        spark.range(step).coalesce(1).write.mode("overwrite").json(f"{base}/{model}/checkpoint-{step}")
    index = readers.files(spark, base, "*.json")
    path = F.col("path")
    one = index.select(readers.path_part_from_end(path, 3).alias("model"), readers.checkpoint_step(path).alias("step"), "path", "modified", (F.col("bytes") > 0).alias("filled"))
    last = readers.latest_per_key(one, F.col("model"), "modified").select(F.col("path").alias("last"))
    named = readers.latest_per_key(one, F.col("model")).select(F.col("path").alias("named"))
    first = readers.first_per_key(one, F.col("model")).select(F.col("path").alias("first"))
    marks = one.join(last, F.col("path") == F.col("last"), "left").join(named, F.col("path") == F.col("named"), "left").join(first, F.col("path") == F.col("first"), "left")
    return marks.select("model", "step", "filled", F.col("last").isNotNull().alias("last"), F.col("named").isNotNull().alias("named"), F.col("first").isNotNull().alias("first"))


RUNS_SQL = "SELECT * FROM (VALUES ('m1', 5, true, false, true, false), ('m1', 20, true, true, false, true), ('m2', 100, true, true, true, true)) AS t(model, step, filled, last, named, first)"


def stored_state(spark: SparkSession, folder: str) -> DataFrame:
    """State of a long build kept as a table in the shared folder and gone on from there."""
    kept = stored(table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
    return kept.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


def windowed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream: running scores per day and type under a watermark; the last state of the stream is the whole."""
    base = scratch(spark, "windows")
    schema = table(spark, folder, "events").schema
    stream = live.sample_stream(spark, f"{folder}/event[s].parquet", schema, fmt="parquet").withColumns({"target": F.lit(10.0), "at": F.col("ts").cast("timestamp")})
    scores = live.running_scores(stream, "event_type", "value", "target", "at", "1 hour", "1 day")
    flat = scores.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mra", "cape", "mean")
    query = flat.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("day", "event_type", "n", *[r(c).alias(c) for c in ("mra", "cape", "mean")])


WINDOWED_SQL = f"""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(coalesce({mra_sql("value", "10.0::DOUBLE")}, 0)), 6) AS mra, round(avg(coalesce({cape_sql("value", "10.0::DOUBLE")}, 1)), 6) AS cape,
    round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"""


def _e(i: int):
    return F.col("embedding")[i].cast("double")


def _sql_e(i: int) -> str:
    return f"embedding[{i + 1}]::DOUBLE"


def list_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Mean clipped error of three answers at a time, and a value looked up in nested maps."""
    nested = F.create_map(F.lit("a"), F.create_map(F.lit("b"), F.col("label").cast("string")))
    pred, truth = F.array(_e(0), _e(1), F.when(F.col("vec_id") % 11 == 0, None).otherwise(_e(2))), F.array(_e(3), F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(_e(4)), _e(5))
    return table(spark, folder, "embeddings").select("vec_id", r(metrics.cape_list(pred, truth)).alias("cape"), arrays.nested_get(nested, "a", "b").alias("found"), arrays.nested_get(nested, "a", "c").alias("missing"))


LIST_SQL = f"""SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN round(({cape_sql(_sql_e(0), _sql_e(3))} + CASE WHEN vec_id % 7 = 0 THEN 1.0 ELSE {cape_sql(_sql_e(1), _sql_e(4))} END + {cape_sql(_sql_e(2), _sql_e(5))}) / 3, 6) END AS cape,
    label::VARCHAR AS found, NULL::VARCHAR AS missing FROM embeddings"""

PATTERNS = ("passby", "spherical", "approach", "around")


def frame_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as runs of six frames: whether the first box will do for a motion pattern, and the quality of the run."""
    rows = table(spark, folder, "embeddings").withColumn("pattern", F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (F.col("vec_id") % 4 + 1).cast("int"))).withColumn("way", F.when(F.col("vec_id") % 8 < 4, "fw").otherwise("bw"))
    areas = F.transform(F.slice("embedding", 1, 6), lambda x: F.round(F.abs(x.cast("double")) / 10, 6))
    centres = F.transform(F.slice("embedding", 7, 6), lambda x: F.round(F.abs(x.cast("double")), 6))
    good = frames.usable_box(F.col("pattern"), areas[0], centres[0], centres[1])
    return rows.select("vec_id", good.alias("usable"), r(frames.run_quality(F.col("pattern"), F.col("way"), areas, centres)).alias("quality"))


QUALITY_SQL = """
    WITH e AS (SELECT vec_id, ['passby', 'spherical', 'approach', 'around'][vec_id % 4 + 1] AS p, CASE WHEN vec_id % 8 < 4 THEN 'fw' ELSE 'bw' END AS way, list_transform(embedding[1:6], lambda x: round(abs(x::DOUBLE) / 10, 6)) AS a, list_transform(embedding[7:12], lambda x: round(abs(x::DOUBLE), 6)) AS c FROM embeddings),
    s AS (SELECT *, list_filter(list_transform(range(1, 6), lambda i: a[i + 1] - a[i]), lambda d: abs(d) >= 1e-6) AS da, list_filter(list_transform(range(1, 6), lambda i: c[i + 1] - c[i]), lambda d: abs(d) >= 1e-6) AS dc FROM e)
    SELECT vec_id, CASE p WHEN 'passby' THEN a[1] >= 1.0 / 700.0 AND c[1] BETWEEN 0.02 AND 0.98 AND abs(c[2] - 0.5) <= 0.4 WHEN 'spherical' THEN a[1] >= 0.01 AND abs(c[1] - 0.5) <= 0.28 AND abs(c[2] - 0.5) <= 0.28
            WHEN 'approach' THEN a[1] >= 0.01 AND abs(c[1] - 0.5) <= 0.2 AND abs(c[2] - 0.5) <= 0.25 ELSE a[1] >= 0.01 END AS usable,
        round(list_sum(a) / 6 * 1000 + CASE p WHEN 'approach' THEN 100 * coalesce(len(list_filter(da, lambda d: CASE WHEN way = 'fw' THEN d > 0 ELSE d < 0 END)) / nullif(len(da), 0), 1.0)
            WHEN 'passby' THEN 100 * (coalesce(len(list_filter(dc, lambda d: CASE WHEN way = 'bw' THEN d > 0 ELSE d < 0 END)) / nullif(len(dc), 0), 1.0) + list_max(c) - list_min(c))
            WHEN 'spherical' THEN 100 * (1 - list_sum(list_transform(c, lambda x: abs(x - 0.5))) / 6) ELSE 0.0 END, 6) AS quality FROM s
"""


def stacked_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Unit boxes on the places of embeddings: what stands on the box below it, what a camera's depths hide, and sides, ratios and offsets."""
    x, z = F.round(_e(0) * 10, 3), F.round(_e(1) * 10, 3)
    lower = F.struct(F.array(x, F.lit(0.0), z).alias("lo"), F.array(x + 1, F.lit(1.0), z + 1).alias("hi"))
    shift, lift = F.round(_e(2) * 20, 3), F.round(F.abs(_e(3)), 3)
    upper = F.struct(F.array(x + shift, 0.9 + lift, z).alias("lo"), F.array(x + shift + 1, 1.9 + lift, z + 1).alias("hi"))
    depths = F.transform(F.slice("embedding", 5, 8), lambda d: F.round(F.abs(d.cast("double")) * 10, 3))
    seen = geometry.in_camera_frame(x, lift, z, F.lit(90.0))
    flat = geometry.flat_distance(x, z, F.lit(0.0), F.lit(0.0))
    pixel = lambda u, v: F.when(u.isNotNull(), F.struct(u.alias("u"), v.alias("v")))
    spots = F.array(pixel(x * 100, z * 100), pixel(F.lit(None).cast("double"), z), pixel(F.abs(x) * 100, F.abs(z) * 100))
    return table(spark, folder, "embeddings").select(
        "vec_id", geometry.rests_on(lower, upper).alias("stands"), r(geometry.occluded_share(depths, F.lit(1.0))).alias("hidden"), geometry.is_near(flat, 1.5).alias("near"), geometry.is_outside(flat, 1.5).alias("outside"), r(geometry.ratio(F.abs(x) + 1, F.abs(z) + 1)).alias("ratio"),
        r(seen["forward"], 4).alias("forward"), geometry.visible_corners(spots, 640, 480).cast("bigint").alias("seen"), r(geometry.area_share(x, z, x + 64, z + 48, 640, 480)).alias("share"), r(geometry.centre_offset(x, z, x + 64, z + 48, 640, 480)).alias("off"),
    )


STACKED_SQL = f"""
    WITH e AS (SELECT vec_id, round({_sql_e(0)} * 10, 3) AS x, round({_sql_e(1)} * 10, 3) AS z, round({_sql_e(2)} * 20, 3) AS s, round(abs({_sql_e(3)}), 3) AS l, list_transform(embedding[5:12], lambda d: round(abs(d::DOUBLE) * 10, 3)) AS d FROM embeddings)
    SELECT vec_id, abs(0.9 + l - 1.0) <= 0.05 AND x + s < x + 1 AND x < x + s + 1 AS stands, round(len(list_filter(d, lambda v: v < 1.0 - 0.05)) / 8, 6) AS hidden, sqrt(x * x + z * z) <= 1.5 AS near, sqrt(x * x + z * z) > 1.5 AS outside,
        round(greatest(abs(x) + 1, abs(z) + 1) / least(abs(x) + 1, abs(z) + 1), 6) AS ratio, round(x * sin(radians(90.0)) + z * cos(radians(90.0)), 4) AS forward,
        CAST((x BETWEEN 0 AND 6.4 AND z BETWEEN 0 AND 4.8)::INT + (abs(x) * 100 BETWEEN 0 AND 640 AND abs(z) * 100 BETWEEN 0 AND 480)::INT AS BIGINT) AS seen, round(64.0 * 48.0 / (640 * 480), 6)::DOUBLE AS share,
        round(sqrt((x + 32 - 320) * (x + 32 - 320) + (z + 24 - 240) * (z + 24 - 240)) / (sqrt(640.0 * 640 + 480 * 480) / 2), 6) AS off FROM e
"""


def path_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """For each nation the poses of a spiral, the points of a straight path, and how many poses a path of its length has."""
    k = F.col("n_nationkey")
    spiral = F.transform(geometry.spiral(F.lit(0.0), F.lit(1.0), F.lit(1.0), 1.0 + k / 5.0, 2.0, 9), lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z")))
    line = geometry.straight(F.lit(0.0), k.cast("double"), F.lit(4.0), F.lit(2.0), 9)
    rows = table(spark, folder, "nation").select("n_nationkey", geometry.linear_steps(k.cast("double"), 0.7).cast("bigint").alias("steps"), F.size(geometry.distance_buckets(1.0, 3.0, 0.5)).cast("bigint").alias("buckets"), F.posexplode(F.arrays_zip(spiral.alias("s"), line.alias("l"))).alias("i", "p"))
    return rows.select("n_nationkey", F.col("i").cast("bigint").alias("i"), "steps", "buckets", r("p.s.x", 4).alias("sx"), r("p.s.z", 4).alias("sz"), r("p.l.x", 4).alias("lx"), r("p.l.z", 4).alias("lz"))


PATHS_SQL = """
    WITH p AS (SELECT n_nationkey AS k, i, i / 8.0::DOUBLE AS t FROM nation, (SELECT unnest(range(0, 9)) AS i)), a AS (SELECT *, radians(t * 720.0) AS a, 1.0 + (k / 5.0::DOUBLE) * t AS rad FROM p)
    SELECT k AS n_nationkey, i, CAST(greatest(2, floor(k / 0.7::DOUBLE) + 1) AS BIGINT) AS steps, 5::BIGINT AS buckets, round(rad * sin(a), 4) + 0.0 AS sx, round(1.0 + rad * cos(a), 4) + 0.0 AS sz, round(4.0 * t, 4) AS lx, round(k + (2.0 - k) * t, 4) AS lz FROM a
"""


def id_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """What ids tell: the motion in a group id, the cycles in a tag, the labels in a pair question's id, the frame of an image, the primary object's label."""
    clips = table(spark, folder, "clips").select("group_id", "variation_tag", "cycle_count", "anchor_ids").distinct()
    pair = text.pair_in_question_id(F.concat(F.lit("object_pair_distance_center_"), F.lit("Bed|+00.10|-01.20|+02.00_Sofa|"), F.lit("-00.10|+01.20|+02.00")))
    frame = F.concat(F.lit("v/frame_"), F.lpad(F.coalesce("cycle_count", F.lit(0)).cast("string"), 5, "0"), F.lit(".png"))
    return clips.select(
        text.motion_in_group_id(F.col("group_id")).alias("motion"), text.cycles_in_tag(F.col("variation_tag")).alias("cycles"), F.concat_ws("/", pair["a"], pair["b"]).alias("pair"), text.frame_number(frame).alias("frame"),
        text.primary_label(F.col("anchor_ids")[0]).alias("primary"), text.after_last_slash(frame).alias("file"),
    ).groupBy("motion", "cycles", "pair", "frame", "primary", "file").agg(F.count(F.lit(1)).alias("n"))


PATTERNS_SQL = r"""
    WITH c AS (SELECT DISTINCT group_id, variation_tag, cycle_count, anchor_ids FROM clips)
    SELECT nullif(regexp_extract(group_id, '^[a-z]+_(\w+?)_object_(?:pair_distance_center|distance_to_camera|dimensions)(?:_|$)', 1), '') AS motion, try_cast(nullif(regexp_extract(variation_tag, '(?:^|_)([0-9]+)x(?:_|$)', 1), '') AS INT) AS cycles,
        'Bed/Sofa' AS pair, coalesce(cycle_count, 0)::INT AS frame, nullif(split_part(anchor_ids[1], '|', 1), '') AS "primary", 'frame_' || lpad(coalesce(cycle_count, 0)::VARCHAR, 5, '0') || '.png' AS file, count(*) AS n FROM c GROUP BY 1, 2, 4, 5, 6
"""


def settings_of_builds(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as builds: how many clips each group takes, which radii, and what is wrong with the settings, if anything."""
    rows = []
    for k in (x["n_nationkey"] for x in table(spark, folder, "nation").collect()):  # 25 rows
        c = BuildConfig(group_size=k, min_group_size=5, engines=("thor",), scenes={"thor": ("a", "b")}, radii=(3.0, 1.0, 2.0, 1.0), radius_count=k % 5 + 1)
        rows.append((k, len(c.problems()), ",".join(f"{x:.0f}" for x in c.radii_of_a_group())))
    return spark.createDataFrame(rows, "n_nationkey bigint, problems bigint, radii string")


BUILDS_SQL = "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 1 ELSE 0 END::BIGINT AS problems, ['1', '1,3', '1,2,3', '1,2,3,1', '1,2,3,1,2'][n_nationkey % 5 + 1] AS radii FROM nation"


def catalog() -> dict:
    return {
        "directory_union": (directory_union, UNION_SQL),
        "json_documents": (json_documents, DOCUMENTS_SQL),
        "json_array_scan": (json_array_scan, ARRAY_SQL),
        "plan_round_trip": (plan_round_trip, PLAN_SQL),
        "report_sinks": (report_sinks, SINKS_SQL),
        "validated_source": (validated_source, VALIDATED_SQL),
        "run_files": (run_files, RUNS_SQL),
        "stored_state": (stored_state, "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1"),
        "windowed_scores": (windowed_scores, WINDOWED_SQL),
        "list_errors": (list_errors, LIST_SQL),
        "frame_quality": (frame_quality, QUALITY_SQL),
        "stacked_boxes": (stacked_boxes, STACKED_SQL),
        "path_shapes": (path_shapes, PATHS_SQL),
        "id_patterns": (id_patterns, PATTERNS_SQL),
        "build_settings": (settings_of_builds, BUILDS_SQL),
    }
