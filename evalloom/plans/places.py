"""Queries on geometry, identifiers, files, streams and whole evaluation tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions import geometry, metrics, text
from evalloom.operators import breakdown
from evalloom.operators.joins import last_wins
from evalloom.operators.reshape import turn
from evalloom.plans import hooks, scoring
from evalloom.plans.tables import cape_sql, mra_sql, r, table
from evalloom.session import scratch
from evalloom.sources import readers, writers
from evalloom.streaming import live


def _corners():
    e = F.transform("embedding", lambda x: x.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(e, i * 3 + 1, 3))


def geometry_bbox(spark: SparkSession, folder: str) -> DataFrame:
    """Object sizes from eight corners: the first 24 numbers of each embedding."""
    size = geometry.object_size(_corners())
    box = geometry.box_of(_corners())
    return table(spark, folder, "embeddings").select("vec_id", *[r(size[c]).alias(c) for c in ("length", "width", "height")], r(geometry.volume(box)).alias("volume"))


def _axis(i: int, f: str) -> str:
    return f"list_{f}([" + ", ".join(f"embedding[{3 * k + i + 1}]::DOUBLE" for k in range(8)) + "])"


BBOX_SQL = f"""
    WITH e AS (SELECT vec_id, {_axis(0, "max")} - {_axis(0, "min")} AS dx, {_axis(1, "max")} - {_axis(1, "min")} AS dy, {_axis(2, "max")} - {_axis(2, "min")} AS dz FROM embeddings)
    SELECT vec_id, round(greatest(dx, dz), 6) AS length, round(least(dx, dz), 6) AS width, round(dy, 6) AS height, round(dx * dy * dz, 6) AS volume FROM e
"""


def projection(spark: SparkSession, folder: str) -> DataFrame:
    """Points of the embeddings seen by a camera: angles, distance and pixels."""
    x, y, z = [F.col("embedding")[i].cast("double") for i in range(3)]
    yaw, pitch = F.pmod(F.col("vec_id") * 7.0, F.lit(360.0)), F.pmod(F.col("vec_id") * 3.0, F.lit(40.0)) - 20
    seen = geometry.project(x, y, z, yaw, pitch, 90.0, 640, 480, near=0.01)
    return table(spark, folder, "embeddings").select("vec_id", r(geometry.heading(x, z), 4).alias("heading"), r(geometry.pitch_to(y, F.hypot(x, z)), 4).alias("pitch"), r(geometry.distance(F.array(x, y, z), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))).alias("distance"), r(seen["depth"], 4).alias("depth"))


PROJECTION_SQL = """
    WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, radians((vec_id * 7.0::DOUBLE) % 360) AS a, radians((vec_id * 3.0::DOUBLE) % 40 - 20) AS p FROM embeddings),
    d AS (SELECT *, (x * sin(a) + z * cos(a)) * cos(p) - y * sin(p) AS depth FROM e)
    SELECT vec_id, round(CASE WHEN degrees(atan2(x, z)) < 0 THEN degrees(atan2(x, z)) + 360 ELSE degrees(atan2(x, z)) END, 4) AS heading,
        round(least(60.0, greatest(-30.0, -degrees(atan2(y, sqrt(x * x + z * z))))), 4) AS pitch, round(sqrt(x * x + y * y + z * z), 6) AS distance, round(CASE WHEN depth > 0.01 THEN depth END, 4) AS depth FROM d
"""


def orbits(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve poses around the origin for each nation, if all lie within bounds."""
    radius = 1.0 + F.col("n_nationkey") / 10.0
    poses = geometry.all_or_nothing(geometry.orbit(F.lit(0.0), F.lit(0.0), radius, F.col("n_nationkey") * 5.0, 12), lambda p: F.abs(p["x"]) <= 3.0)
    return table(spark, folder, "nation").select("n_nationkey", F.posexplode(poses).alias("pos", "p")).select("n_nationkey", F.col("pos").cast("bigint").alias("pos"), r("p.angle", 4).alias("angle"), r("p.x", 4).alias("x"), r("p.z", 4).alias("z"))


ORBITS_SQL = """
    WITH p AS (SELECT n_nationkey, i AS pos, (n_nationkey * 5.0::DOUBLE + i * 30.0) % 360 AS angle, 1.0 + n_nationkey / 10.0::DOUBLE AS rad FROM nation, (SELECT unnest(range(0, 12)) AS i))
    SELECT n_nationkey, pos, round(angle, 4) AS angle, round(rad * sin(radians(angle)), 4) + 0.0 AS x, round(rad * cos(radians(angle)), 4) + 0.0 AS z FROM p
    WHERE n_nationkey NOT IN (SELECT n_nationkey FROM p WHERE abs(rad * sin(radians(angle))) > 3.0)
"""


def box_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Containment and support between the boxes of neighbouring embeddings of a label."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", geometry.box_of(_corners()).alias("box"))
    rows = rows.withColumn("other", F.lag("box").over(Window.partitionBy("label").orderBy("vec_id"))).where("other is not null")
    return rows.select("vec_id", r(geometry.overlap_volume(F.col("box"), F.col("other"))).alias("common"), geometry.contains(F.col("box"), F.col("other"), 0.5).alias("holds"))


BOXES_SQL = f"""
    WITH e AS (SELECT vec_id, label, {", ".join(f"{_axis(i, f)} AS {f}{i}" for i in range(3) for f in ("min", "max"))} FROM embeddings),
    o AS (SELECT *, {", ".join(f"lag({f}{i}) OVER w AS {f}o{i}" for i in range(3) for f in ("min", "max"))} FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    v AS (SELECT vec_id, {" * ".join(f"greatest(0.0, least(max{i}, maxo{i}) - greatest(min{i}, mino{i}))" for i in range(3))} AS c, {" * ".join(f"(maxo{i} - mino{i})" for i in range(3))} AS inner_volume, abs(min1 - mino1) AS floors FROM o WHERE mino0 IS NOT NULL)
    SELECT vec_id, round(c, 6) AS common, c / inner_volume >= 0.5 AND inner_volume > 1e-9 AND floors >= 0.01 AS holds FROM v
"""


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", text.stable_id(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), seed="s").alias("id"))


IDS_SQL = "SELECT o_orderkey, CAST('0x' || substr(sha256('s|' || o_orderkey || '|' || o_orderstatus), 1, 12) AS BIGINT) AS id FROM orders"


def scene_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers at the end of scene names and the room kind they would stand for; bases and ends of trajectories."""
    n = text.scene_number(F.col("scene_id"))
    return table(spark, folder, "clips").select("scene_id", "trajectory").distinct().select("scene_id", "trajectory", n.alias("number"), text.room_of_number(F.pmod(n, F.lit(500))).alias("room"), text.trajectory_base(F.col("trajectory")).alias("base"), text.direction_of(F.col("trajectory")).alias("way"))


NUMBERS_SQL = """
    WITH s AS (SELECT DISTINCT scene_id, trajectory, try_cast(nullif(regexp_extract(scene_id, '([0-9]+)$', 1), '') AS INT) AS n FROM clips)
    SELECT scene_id, trajectory, n AS number, CASE WHEN n % 500 BETWEEN 1 AND 30 THEN 'kitchen' WHEN n % 500 BETWEEN 201 AND 230 THEN 'living_room' WHEN n % 500 BETWEEN 301 AND 330 THEN 'bedroom'
        WHEN n % 500 BETWEEN 401 AND 430 THEN 'bathroom' ELSE 'other' END AS room, regexp_replace(trajectory, '_[^_]*$', '') AS base, string_split(trajectory, '_')[-1] AS way FROM s
"""



def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Group records written as JSON lines to the shared folder and read again with an explicit schema."""
    out = scratch(spark, "json")
    schema = T.StructType([T.StructField("group_id", T.StringType()), T.StructField("clip_ids", T.ArrayType(T.StringType())), T.StructField("radius", T.DoubleType()), T.StructField("anchor_labels", T.ArrayType(T.StringType()))])
    table(spark, folder, "consistency_groups").select(*schema.names).write.mode("overwrite").json(out)
    back = readers.json_lines(spark, out, schema, {"task": "groups"})
    return back.groupBy("task", "group_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("clip_ids")).cast("bigint").alias("clips"), F.max("radius").alias("radius"))


JSON_SQL = "SELECT 'groups' AS task, group_id, count(*) AS n, max(len(clip_ids)) AS clips, max(radius) AS radius FROM consistency_groups GROUP BY 2"


def conversation_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations of the current clips written as training lines and read again."""
    out = scratch(spark, "talk")
    clips = last_wins(table(spark, folder, "clips"), ["clip_id"], "ingested_at", ["video_path", "question", "ground_truth"])
    writers.write_conversations(clips, F.col("question"), F.coalesce("ground_truth", F.lit("unknown")), "video_path", out)
    back = spark.read.schema("video string, conversations array<struct<`from`:string,value:string>>").json(out)
    return back.groupBy(turn(F.col("conversations"), "gpt").alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.count("video").alias("with_video"))


TALK_SQL = """SELECT coalesce(ground_truth, 'unknown') AS answer, count(*) AS n, count(video_path) AS with_video FROM (
    SELECT * FROM clips QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC) = 1) GROUP BY 1"""


def table_files(spark: SparkSession, folder: str) -> DataFrame:
    """The tables found in the folder, by file name, with the last file of each."""
    index = readers.files(spark, folder, "*.parquet")
    key = F.regexp_extract("path", r"/(\w+)\.parquet", 1)
    return readers.latest_per_key(index, key).select("key", F.col("path").isNotNull().alias("there"))


#: The tables that the driver's folder holds.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "clips", "consistency_groups", "candidate_groups", "plan_settings", "split_targets", "source_weights", "sample_targets", "lang_samples"]


def streamed_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as a stream; running scores per user, then, in each batch, mean dispersion per event type. The last batch is the whole."""
    base = scratch(spark, "stream")
    schema = table(spark, folder, "events").schema
    stream = live.sample_stream(spark, f"{folder}/event[s].parquet", schema, fmt="parquet").withColumn("target", F.lit(10.0))
    running = stream.groupBy("event_type", "user_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    live.slice_reports(running, "event_type", "user_id", f"{base}/out", f"{base}/state").awaitTermination()
    reports = spark.read.parquet(f"{base}/out")
    last = reports.agg(F.max("batch").alias("batch"))
    return reports.join(last, "batch").select("event_type", "n_groups", r("mean_cv").alias("mean_cv"))


STREAM_SQL = """SELECT event_type, count(cv) AS n_groups, round(avg(cv), 6) AS mean_cv FROM (
    SELECT event_type, user_id, CASE WHEN count(value) >= 2 AND avg(value) > 0 THEN stddev_samp(value) / avg(value) END AS cv FROM events GROUP BY 1, 2) GROUP BY 1"""


@hooks.hook("score_lines")
def _score_lines(docs: DataFrame) -> DataFrame:
    p, t = F.col("pred"), F.col("target")
    return docs.withColumn("mra", metrics.scored("mra", p, t)).withColumn("cape", metrics.scored("cape", p, t))


@hooks.hook("mean_by_brand")
def _mean_by_brand(scored: DataFrame) -> DataFrame:
    out = scored.groupBy("p_brand").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("mra"), 6).alias("mra"), F.round(F.avg("cape"), 6).alias("cape"))
    return breakdown.long_metrics(out, ["p_brand"], ["n", "mra", "cape"])


def task_hooks(spark: SparkSession, folder: str) -> DataFrame:
    """A task defined by hook names, from rows to long metrics."""
    task = hooks.Task("lines", prompt=lambda: text.compose_prompt(F.col("p_brand")), process="score_lines", aggregate="mean_by_brand")
    return task.run(scoring.scored_lines(spark, folder))


HOOKS_SQL = f"""
    WITH m AS (SELECT p_brand, CAST(count(*) AS DOUBLE) AS n, round(avg({mra_sql("pred", "target")}), 6) AS mra, round(avg({cape_sql("pred", "target")}), 6) AS cape FROM ({scoring.LINES_SQL}) GROUP BY 1)
    SELECT p_brand, 'n' AS metric, n AS v FROM m UNION ALL SELECT p_brand, 'mra', mra FROM m UNION ALL SELECT p_brand, 'cape', cape FROM m
"""


def variation_settings(spark: SparkSession, folder: str) -> DataFrame:
    """The sixty settings of twelve start angles and five cycle counts, with how many clips have each."""
    grid = spark.range(60).select((F.col("id") % 12 * 30).cast("double").alias("angle"), (F.floor(F.col("id") / 12) + 1).cast("int").alias("cycles"))
    clips = table(spark, folder, "clips").groupBy(F.col("start_angle_offset").alias("angle"), F.col("cycle_count").alias("cycles")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(clips, ["angle", "cycles"], "left").select("angle", "cycles", F.coalesce("n", F.lit(0)).alias("n"))


SETTINGS_SQL = """
    WITH g AS (SELECT CAST(i % 12 * 30 AS DOUBLE) AS angle, i // 12 + 1 AS cycles FROM (SELECT unnest(range(0, 60)) AS i))
    SELECT angle, CAST(cycles AS INT) AS cycles, count(clip_id) AS n FROM g LEFT JOIN clips ON start_angle_offset = angle AND cycle_count = cycles GROUP BY 1, 2
"""


def catalog() -> dict:
    return {
        "geometry_bbox": (geometry_bbox, BBOX_SQL),
        "projection": (projection, PROJECTION_SQL),
        "orbits": (orbits, ORBITS_SQL),
        "box_relations": (box_relations, BOXES_SQL),
        "stable_ids": (stable_ids, IDS_SQL),
        "scene_numbers": (scene_numbers, NUMBERS_SQL),
        "variation_settings": (variation_settings, SETTINGS_SQL),
        "json_round_trip": (json_round_trip, JSON_SQL),
        "conversation_round_trip": (conversation_round_trip, TALK_SQL),
        "table_files": (table_files, f"SELECT unnest({TABLES}) AS key, true AS there"),
        "streamed_scores": (streamed_scores, STREAM_SQL),
        "task_hooks": (task_hooks, HOOKS_SQL),
    }
