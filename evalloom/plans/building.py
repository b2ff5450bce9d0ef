"""Queries on what is built from objects and clips: comparison questions, roll-ups, nested counters and assembled records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import geometry, metrics
from evalloom.operators import breakdown, distribution, generation, greedy, reshape
from evalloom.operators.joins import last_wins
from evalloom.plans.selecting import GROUP_CLIPS_SQL, _picked_clips
from evalloom.plans.tables import mra_sql, r, table

DIMS = ("length", "width", "height")


def _objects(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as objects of a scene (their label): a name, three sizes, a place."""
    e = lambda i: F.col("embedding")[i].cast("double")
    sizes = [F.round(F.abs(e(i)), 3).alias(d) for i, d in enumerate(DIMS)]
    return table(spark, folder, "embeddings").select("label", "vec_id", F.concat(F.lit("box "), "vec_id").alias("name"), *sizes, F.array(*[F.round(e(i) * 10, 3) for i in (3, 4, 5)]).alias("place"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return generation.first_pairs(_objects(spark, folder), "label", "vec_id", ["name", *DIMS, "place"], 10)


_OBJECTS_SQL = f"""
    o AS (SELECT label, vec_id, 'box ' || vec_id AS name, {", ".join(f"round(abs(embedding[{i + 1}]::DOUBLE), 3) AS {d}" for i, d in enumerate(DIMS))}, {", ".join(f"round(embedding[{i + 1}]::DOUBLE * 10, 3) AS p{i}" for i in (3, 4, 5))} FROM embeddings),
    p AS (SELECT a.label, row_number() OVER (PARTITION BY a.label ORDER BY a.vec_id, b.vec_id) - 1 AS pair, {", ".join(f"{s}.{c} AS {c}_{s}" for s in "ab" for c in ("vec_id", "name", *DIMS, "p3", "p4", "p5"))}
        FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 11) a JOIN (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 11) b ON a.label = b.label AND a.vec_id < b.vec_id
        QUALIFY pair < 10),
    d AS (SELECT *, sqrt((p3_a - p3_b) * (p3_a - p3_b) + (p4_a - p4_b) * (p4_a - p4_b) + (p5_a - p5_b) * (p5_a - p5_b)) AS gap FROM p)
"""


def size_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """Ratio and given-size questions for the first ten pairs of each label."""
    out = generation.size_comparisons(_pairs(spark, folder), ["vec_id_a", "vec_id_b"], "name", list(DIMS))
    return out.select("vec_id_a", "vec_id_b", "question_type", "dimension", "question", "answer")


COMPARISONS_SQL = f"WITH {_OBJECTS_SQL} " + " UNION ALL ".join(
    f"SELECT vec_id_a, vec_id_b, 'object_size_comparison_relative' AS question_type, '{d}' AS dimension, 'How many times the {d} of the ' || name_b || ' is the {d} of the ' || name_a || '?' AS question, round({d}_a / {d}_b + 1e-9, 1) AS answer FROM p WHERE {d}_b <> 0 "
    f"UNION ALL SELECT vec_id_a, vec_id_b, 'object_size_comparison_absolute', '{d}', 'If the {d} of the ' || name_b || ' is ' || format('{{:.1f}}', round({d}_b + 1e-9, 1)) || ' metres, what is the {d} of the ' || name_a || ' in metres?', round({d}_a + 1e-9, 1) FROM p WHERE {d}_b <> 0"
    for d in DIMS
)


def distance_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of the first ten pairs of each label, plain and with a size given."""
    return generation.distance_rows(_pairs(spark, folder), ["vec_id_a", "vec_id_b"], "name", "place", list(DIMS))


DISTANCES_SQL = f"""WITH {_OBJECTS_SQL}, q AS (SELECT *, round(gap + 1e-9, 1) AS answer, 'How far apart are the ' || name_a || ' and the ' || name_b || ', in metres?' AS question FROM d)
    SELECT vec_id_a, vec_id_b, 'object_pair_distance_center' AS question_type, NULL AS dimension, question, answer FROM q""" + "".join(
    f" UNION ALL SELECT vec_id_a, vec_id_b, 'object_pair_distance_center_w_size', '{d}', 'The ' || name_a || ' has a {d} of ' || format('{{:.1f}}', round({d}_a + 1e-9, 1)) || ' metres. ' || question, answer FROM q WHERE {d}_a <> 0" for d in DIMS
)


def distance_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """Each of the first pairs of a label against the next one."""
    p = _pairs(spark, folder).select("label", "pair", "name_a", "name_b", geometry.distance(F.col("place_a"), F.col("place_b")).alias("gap"))
    nxt = p.select("label", (F.col("pair") - 1).alias("pair"), F.col("name_a").alias("name_x"), F.col("name_b").alias("name_y"), F.col("gap").alias("gap_xy"))
    quads = p.join(nxt, ["label", "pair"]).withColumn("pair", F.col("pair").cast("bigint"))
    return generation.distance_comparisons(quads, ["label", "pair"], ["name_a", "name_b", "name_x", "name_y"], F.col("gap"), F.col("gap_xy")).drop("dimension")


QUADS_SQL = f"""WITH {_OBJECTS_SQL}, q AS (SELECT a.label, a.pair, 'the ' || a.name_a || ' and the ' || a.name_b AS ab, 'the ' || x.name_a || ' and the ' || x.name_b AS xy, a.gap AS g, x.gap AS h FROM d a JOIN d x ON a.label = x.label AND x.pair = a.pair + 1)
    SELECT label, pair, 'object_distance_comparison_relative' AS question_type, 'How many times as far apart as ' || xy || ' are ' || ab || '?' AS question, round(g / h + 1e-9, 1) AS answer FROM q WHERE h <> 0
    UNION ALL SELECT label, pair, 'object_comparison_absolute_distance', 'If ' || xy || ' are ' || format('{{:.1f}}', round(h + 1e-9, 1)) || ' metres apart, how far apart are ' || ab || ', in metres?', round(g + 1e-9, 1) FROM q"""


VARIATIONS = {"early": ["click", "view"], "late": ["purchase", "signup"]}


def variation_roll_up(spark: SparkSession, folder: str) -> DataFrame:
    """Events pooled into two kinds: accuracy of their values as answers to 20, and dispersion per user."""
    events = table(spark, folder, "events")
    out = breakdown.roll_up(events, F.col("event_type"), VARIATIONS, "user_id", "value", metrics.mra(F.col("value"), F.lit(20.0)))
    return out.select("variation", "n", r("metric").alias("metric"), "n_groups", r("mean_cv").alias("mean_cv"))


ROLL_SQL = f"""
    WITH e AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'early' WHEN event_type IN ('purchase', 'signup') THEN 'late' END AS variation, user_id, value, {mra_sql("value", "20.0::DOUBLE")} AS m FROM events),
    g AS (SELECT variation, user_id, CASE WHEN count(value) >= 2 AND avg(value) <> 0 THEN stddev_samp(value) / avg(value) END AS cv FROM e WHERE user_id IS NOT NULL AND variation IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT variation, count(cv) AS n_groups, round(avg(cv), 6) AS mean_cv FROM g GROUP BY 1)
    SELECT variation, count(*) AS n, round(avg(m) * 100, 6) AS metric, any_value(n_groups) AS n_groups, any_value(mean_cv) AS mean_cv FROM e JOIN c USING (variation) GROUP BY 1
"""


def easiest_hardest(spark: SparkSession, folder: str) -> DataFrame:
    """For each market segment the nations of the highest and lowest mean balance."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    each = table(spark, folder, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("score")).join(nations, "c_nationkey")
    return breakdown.extremes(each, ["c_mktsegment"], "n_name", "score")


EXTREMES_SQL = """
    WITH s AS (SELECT c_mktsegment, n_name, round(avg(c_acctbal), 4) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT c_mktsegment, arg_min(n_name, (-score, n_name)) AS easiest, max(score) AS highest, arg_min(n_name, (score, n_name)) AS hardest, min(score) AS lowest FROM s GROUP BY 1
"""


def preferred_order(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by priority with the place of each in a preferred order."""
    counts = table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", breakdown.preferred_order(F.col("o_orderpriority"), ["3-MEDIUM", "1-URGENT"]).cast("bigint"))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Groups with a question for each of their clips."""
    groups = table(spark, folder, "consistency_groups").groupBy("group_id").agg(F.min("room_bucket").alias("room"), F.min("motion_family").alias("motion"), F.min("engine").alias("engine"))
    clips = last_wins(table(spark, folder, "clips"), ["clip_id"], "ingested_at", ["group_id", "question_type", "anchor_labels"])
    questions = reshape.nest(clips, ["group_id"], "clip_id", ["question_type", "anchor_labels"], "questions")
    return groups.join(questions, "group_id", "left")


ENTRIES_SQL = """
    g AS (SELECT group_id, min(room_bucket) AS room, min(motion_family) AS motion, min(engine) AS engine FROM consistency_groups GROUP BY 1),
    c AS (SELECT clip_id, group_id, question_type, anchor_labels FROM clips QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC) = 1),
    q AS (SELECT coalesce(room, '?') AS room, coalesce(motion, '?') AS motion, engine, question_type, anchor_labels FROM g JOIN c USING (group_id)),
    l AS (SELECT question_type, unnest(anchor_labels) AS label FROM q)
"""


def nested_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Groups by room and motion, their questions by type, by type and room or motion, and labels, all in one pass."""
    return distribution.nested_counts(_entries(spark, folder), ["room", "motion"], "questions", "question_type", "anchor_labels")


EXTRACT_SQL = f"""WITH {ENTRIES_SQL}
    SELECT 'room' AS counter, NULL::VARCHAR AS key, coalesce(room, '?') AS value, count(*) AS n FROM g GROUP BY 3 UNION ALL SELECT 'motion', NULL, coalesce(motion, '?'), count(*) FROM g GROUP BY 3
    UNION ALL SELECT 'question_type', NULL, question_type, count(*) FROM q GROUP BY 3 UNION ALL SELECT 'question_type_room', question_type, room, count(*) FROM q GROUP BY 2, 3
    UNION ALL SELECT 'question_type_motion', question_type, motion, count(*) FROM q GROUP BY 2, 3 UNION ALL SELECT 'anchor_labels', NULL, label, count(*) FROM l WHERE label IS NOT NULL GROUP BY 3
    UNION ALL SELECT 'question_type_anchor_labels', question_type, label, count(*) FROM l WHERE label IS NOT NULL GROUP BY 2, 3"""


def multiview_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the groups as multi-view records; a scene is a room here."""
    return distribution.multiview_stats(_entries(spark, folder), "room", "questions", "question_type").withColumn("v", r("v"))


MULTIVIEW_SQL = f"""WITH {ENTRIES_SQL}
    SELECT 'records' AS metric, NULL::VARCHAR AS value, count(*)::DOUBLE AS v FROM g UNION ALL SELECT 'questions', NULL, count(*)::DOUBLE FROM q UNION ALL SELECT 'scenes', NULL, count(DISTINCT room)::DOUBLE FROM g
    UNION ALL SELECT 'questions_per_record', NULL, round((SELECT count(*) FROM q) / (SELECT count(*) FROM g), 6) UNION ALL SELECT 'questions_of_kind', question_type, count(*)::DOUBLE FROM q GROUP BY 2"""


def assembled_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the groups that have four diverse clips or more of six wanted, with clips numbered anew."""
    picked = greedy.clips_of_group(_picked_clips(spark, folder), "group_id", "clip_id", ["trajectory", "direction", "variation_tag"], "quality_score", 6)
    groups = table(spark, folder, "consistency_groups").groupBy("group_id").agg(F.min("engine").alias("engine"), F.min("question_type").alias("question_type"))
    out = reshape.assemble_groups(picked, "group_id", "clip_id", "position", groups, ["engine", "question_type"], 6, 4, "out")
    return out.select("group_id", "engine", "question_type", F.concat_ws(" ", "clip_ids").alias("clip_ids"), F.concat_ws(" ", F.transform("clips", lambda c: c["source"])).alias("sources"), F.col("clips")[0]["video_path"].alias("first_video"), "selected_group_size")


ASSEMBLED_SQL = f"""
    WITH s AS ({GROUP_CLIPS_SQL}), p AS (SELECT group_id, count(*) AS k, string_agg(clip_id, ' ' ORDER BY position) AS sources, string_agg(group_id || '_clip' || format('{{:02d}}', position - 1), ' ' ORDER BY position) AS clip_ids FROM s GROUP BY 1 HAVING count(*) >= 4)
    SELECT group_id, min(engine) AS engine, min(question_type) AS question_type, any_value(p.clip_ids) AS clip_ids, any_value(p.sources) AS sources, 'out/videos/' || group_id || '_clip00/video.mp4' AS first_video, CAST(any_value(k) AS INT) AS selected_group_size
    FROM consistency_groups JOIN p USING (group_id) GROUP BY group_id
"""


def catalog() -> dict:
    return {
        "size_comparisons": (size_comparisons, COMPARISONS_SQL),
        "distance_rows": (distance_rows, DISTANCES_SQL),
        "distance_comparisons": (distance_comparisons, QUADS_SQL),
        "variation_roll_up": (variation_roll_up, ROLL_SQL),
        "easiest_hardest": (easiest_hardest, EXTREMES_SQL),
        "preferred_order": (preferred_order, "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 999 END::BIGINT AS place FROM orders GROUP BY 1"),
        "nested_extract": (nested_extract, EXTRACT_SQL),
        "multiview_stats": (multiview_stats, MULTIVIEW_SQL),
        "assembled_groups": (assembled_groups, ASSEMBLED_SQL),
    }
