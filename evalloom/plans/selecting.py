"""Queries on selection: top-k, water-filling, quotas, splits, sequences and greedy picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.functions import text
from evalloom.operators import greedy, reshape, sequences, splits, windows
from evalloom.operators.joins import first_wins, last_wins
from evalloom.plans.tables import r, table


def topk_two_pass_diverse(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.two_pass_diverse(table(spark, folder, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey", 4)
    return out.select("o_custkey", "o_orderkey", F.col("position").cast("bigint").alias("position"))


TWO_PASS_SQL = """
    WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) > 1 AS again FROM orders)
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY again, o_totalprice DESC, o_orderkey) AS position FROM t QUALIFY position <= 4
"""


def k_per_stratum(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.top_k(table(spark, folder, "part"), ["p_brand", "p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)
    return out.select("p_brand", "p_type", "p_partkey", F.col("position").cast("bigint").alias("position"))


def water_fill(spark: SparkSession, folder: str) -> DataFrame:
    """60 customers, nations in turn."""
    out = windows.water_fill(table(spark, folder, "customer"), "c_nationkey", ["c_custkey"], 60)
    return out.select("c_nationkey", "c_custkey", F.col("level").cast("bigint").alias("level"))


WATER_SQL = """SELECT c_nationkey, c_custkey, level FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS level FROM customer)
    ORDER BY level, c_nationkey LIMIT 60"""


def hierarchical_fill(spark: SparkSession, folder: str) -> DataFrame:
    """1,000 clips over objects, within them over scenes, within those over motions, as they are written; rows of one clip are one."""
    clips = last_wins(table(spark, folder, "clips"), ["clip_id"], "ingested_at", ["anchor_labels", "scene_id", "motion_family"]).withColumn("object", F.try_element_at("anchor_labels", F.lit(1)))
    out = windows.hierarchical_fill(clips, ["object", "scene_id", "motion_family"], ["clip_id"], 1000)
    return out.select("clip_id", "object", F.col("level").cast("bigint").alias("level"))


FILL_SQL = """
    WITH RECURSIVE c AS (SELECT clip_id, anchor_labels[1] AS object, scene_id, motion_family FROM clips QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC) = 1),
    m AS (SELECT *, row_number() OVER (PARTITION BY object, scene_id, motion_family ORDER BY clip_id) AS t3 FROM c),
    s AS (SELECT *, row_number() OVER (PARTITION BY object, scene_id ORDER BY t3, motion_family NULLS FIRST) AS t2 FROM m),
    o AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY t2, scene_id NULLS FIRST) AS level FROM s),
    n AS (SELECT object, count(*) AS n, row_number() OVER (ORDER BY count(*), object NULLS FIRST) AS i, count(*) OVER () AS k FROM o GROUP BY object),
    q AS (SELECT i, object, k, least(n, 1000 // k) AS quota, 1000 - least(n, 1000 // k) AS rest FROM n WHERE i = 1
        UNION ALL SELECT n.i, n.object, n.k, least(n.n, rest // (n.k - q.i)), rest - least(n.n, rest // (n.k - q.i)) FROM q JOIN n ON n.i = q.i + 1)
    SELECT clip_id, o.object, level FROM o JOIN q ON o.object IS NOT DISTINCT FROM q.object WHERE level <= quota
"""


def bucket_cap_running(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("bigint").alias("size"))
    out = windows.cap_running_size(orders, "o_custkey", ["o_orderkey"], "size", 500_000)
    return out.select("o_custkey", "o_orderkey", "size", F.col("room").cast("bigint").alias("room"))


CAP_SQL = """
    WITH o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders),
    s AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - size AS b FROM o)
    SELECT o_custkey, o_orderkey, size, CAST(least(size, 500000 - b) AS BIGINT) AS room FROM s WHERE b < 500000
"""


def interleave(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.interleave(table(spark, folder, "orders"), "o_orderstatus", ["O", "F", "P"], ["o_orderkey"])
    return out.select("o_orderkey", F.col("turn").cast("bigint").alias("turn"), F.col("seat").cast("bigint").alias("seat"))


INTERLEAVE_SQL = "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS turn, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END::BIGINT AS seat FROM orders"


def even_fill_quota(spark: SparkSession, folder: str) -> DataFrame:
    """Quotas of 120 groups over the motion words of the groups, smallest first."""
    counts = table(spark, folder, "consistency_groups").groupBy(text.motion_of(F.trim("motion_family")).alias("name")).agg(F.count(F.lit(1)).alias("capacity"))
    one = counts.agg(F.collect_list(F.struct("name", "capacity")).alias("c"))  # one row a motion word
    return one.select(F.inline(windows.even_quotas(F.col("c"), F.lit(120))))


EVEN_SQL = """
    WITH RECURSIVE c AS (
        SELECT CASE WHEN m LIKE 'approach%' THEN 'approach' WHEN m LIKE 'passby%' THEN 'passby' WHEN m LIKE 'around%' THEN 'around' WHEN m LIKE 'spherical%' THEN 'spherical'
            WHEN m LIKE 'rotation%' THEN 'rotation' WHEN m LIKE 'linear%' THEN 'linear' ELSE 'other' END AS name, count(*) AS capacity
        FROM (SELECT lower(trim(motion_family)) AS m FROM consistency_groups) GROUP BY 1
    ), o AS (SELECT *, row_number() OVER (ORDER BY capacity, name) AS i, count(*) OVER () AS n FROM c),
    f AS (
        SELECT i, name, capacity, n, least(capacity, 120 // n) AS quota, 120 - least(capacity, 120 // n) AS rest FROM o WHERE i = 1
        UNION ALL SELECT o.i, o.name, o.capacity, o.n, least(o.capacity, rest // (o.n - f.i)), rest - least(o.capacity, rest // (o.n - f.i)) FROM f JOIN o ON o.i = f.i + 1
    )
    SELECT name, capacity, quota FROM f
"""


def even_angles(spark: SparkSession, folder: str) -> DataFrame:
    """Five evenly spread orders of each customer, and whether an order lies in the middle third."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return o.select("o_custkey", "o_orderkey", windows.even_positions(F.col("i"), F.col("n"), 5).alias("picked"), windows.middle_third(F.col("i"), F.col("n")).alias("middle"))


EVEN_ANGLES_SQL = """
    WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, o_orderkey, n <= 5 OR list_contains(list_transform([0, 1, 2, 3, 4], lambda k: CAST(round_even(k * n / 5.0, 0) AS BIGINT) % n), i) AS picked, i >= n // 3 AND i < 2 * n // 3 AS middle FROM o
"""


def consecutive_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.drop_consecutive(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


DEDUP_SQL = "SELECT event_id, user_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"


def islands(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of successive hours in which a user is active."""
    hours = table(spark, folder, "events").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour"))
    return sequences.longest_island(hours, ["user_id"], "hour")


ISLANDS_SQL = """
    WITH h AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events), g AS (SELECT *, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS i FROM h),
    r AS (SELECT user_id, min(hour) AS start, max(hour) AS "end", count(*) AS length FROM g GROUP BY user_id, i)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1
"""


def arc_segments(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", (F.col("value") * 7).alias("angle"))
    out = sequences.arcs(events, ["user_id"], "angle", 25.0)
    return out.select("user_id", r("start", 4).alias("start"), r("end", 4).alias("end"), "n", F.col("arc").cast("bigint").alias("arc"))


ARCS_SQL = """
    WITH e AS (SELECT user_id, value * 7 - 360 * floor(value * 7 / 360) AS a FROM events),
    c AS (SELECT *, CASE WHEN a - lag(a) OVER w > 25 THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY a)),
    p AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY a) AS p FROM c),
    s AS (SELECT user_id, p, min(a) AS start, max(a) AS "end", count(*) AS n FROM p GROUP BY 1, 2),
    w AS (SELECT *, max(p) OVER (PARTITION BY user_id) AS last, min(start) OVER (PARTITION BY user_id) AS low, max("end") OVER (PARTITION BY user_id) AS high FROM s),
    j AS (SELECT user_id, CASE WHEN p = last AND last > 0 AND low + 360 - high <= 25 THEN 0 ELSE p END AS p, start, "end", n FROM w),
    o AS (SELECT user_id, p, CASE WHEN count(*) > 1 THEN max(start) ELSE min(start) END AS start, CASE WHEN count(*) > 1 THEN min("end") ELSE max("end") END AS "end", CAST(sum(n) AS BIGINT) AS n FROM j GROUP BY 1, 2)
    SELECT user_id, round(start, 4) AS start, round("end", 4) AS "end", n, row_number() OVER (PARTITION BY user_id ORDER BY start) AS arc FROM o
"""


def monotonic_fraction(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    out = sequences.monotonic_fraction(events, ["user_id"], ["ts", "event_id"], "value").join(sequences.span(events, ["user_id"], "value"), "user_id")
    return out.select("user_id", r("fraction").alias("fraction"), r("span").alias("span"))


MONOTONIC_SQL = """
    WITH d AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
    SELECT user_id, round(coalesce(count(*) FILTER (WHERE d >= 1e-6) / nullif(count(*) FILTER (WHERE abs(d) >= 1e-6), 0), 1.0), 6) AS fraction, round(max(value) - min(value), 6) AS span FROM d GROUP BY 1
"""


def bounce_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """First three values of each embedding played back and forth four times."""
    e = F.transform(F.slice("embedding", 1, 3), lambda x: F.format_string("%.2f", x.cast("double")))
    return table(spark, folder, "embeddings").select("vec_id", F.concat_ws(" ", sequences.bounce(e, 4)).alias("path"))


BOUNCE_SQL = "SELECT vec_id, concat_ws(' ', a, b, c, b, a, b, c, b, a) AS path FROM (SELECT vec_id, format('{:.2f}', embedding[1]::DOUBLE) AS a, format('{:.2f}', embedding[2]::DOUBLE) AS b, format('{:.2f}', embedding[3]::DOUBLE) AS c FROM embeddings)"


def _sign_bits(n: int = 62):
    return sum((F.when(F.col("embedding")[i] > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(1, n)), F.when(F.col("embedding")[0] > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def hamming_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Different sign bits of each embedding and the first one of its label."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", _sign_bits().alias("bits"))
    first = first_wins(rows, ["label"], "vec_id", ["bits"]).withColumnRenamed("bits", "first_bits")
    return rows.join(first, "label").select("vec_id", sequences.hamming(F.col("bits"), F.col("first_bits")).cast("bigint").alias("distance"))


HAMMING_SQL = """
    WITH b AS (SELECT vec_id, label, list_sum(list_transform(range(0, 62), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS bits FROM embeddings),
    f AS (SELECT label, arg_min(bits, vec_id) AS fb FROM b GROUP BY 1)
    SELECT vec_id, CAST(bit_count(xor(bits, fb)) AS BIGINT) AS distance FROM b JOIN f USING (label)
"""


def hamming_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label", _sign_bits().alias("bits"), F.col("embedding")[63].cast("double").alias("quality"))
    return greedy.hash_distinct(rows, "label", "vec_id", "bits", "quality", 24, 10)


def ood_split(spark: SparkSession, folder: str) -> DataFrame:
    """Groups whose labels are all known, none known (or dropped where mixed)."""
    labels = F.transform("anchor_labels", lambda x: F.lower(F.trim(x)))
    split = splits.ood_split(labels, ["sideboard", "armchair", "bookcase", "footstool"])
    return table(spark, folder, "consistency_groups").where("anchor_labels is not null").select("group_id", split.alias("split")).where("split is not null").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


OOD_SQL = """
    WITH g AS (SELECT list_transform(anchor_labels, lambda x: list_contains(['sideboard', 'armchair', 'bookcase', 'footstool'], lower(trim(x)))) AS k FROM consistency_groups WHERE len(anchor_labels) > 0)
    SELECT CASE WHEN NOT list_contains(k, false) THEN 'eval' WHEN NOT list_contains(k, true) THEN 'train' END AS split, count(*) AS n FROM g GROUP BY 1 HAVING split IS NOT NULL
"""


def leak_free_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.leak_free(table(spark, folder, "orders"), ["o_custkey"], 1000)


LEAK_SQL = """SELECT o_custkey, n, CASE WHEN sum(n) OVER (ORDER BY n, o_custkey) - n < 1000 THEN 'eval' ELSE 'train' END AS split FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"""


def shared_split_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Leak keys that the train split shares with the others, as the clips stand."""
    key = F.array_sort(F.coalesce("anchor_ids", F.array().cast("array<string>")))
    clips = table(spark, folder, "clips").select("split", "question_type", "scene_id", F.concat_ws("|", key).alias("anchors")).where("scene_id is not null")
    return splits.shared_keys(clips.where("split = 'train'"), clips.where("split <> 'train'"), ["question_type", "scene_id", "anchors"])


SHARED_SQL = """
    WITH c AS (SELECT split, question_type, scene_id, coalesce(array_to_string(list_sort(anchor_ids), '|'), '') AS anchors FROM clips WHERE scene_id IS NOT NULL)
    SELECT question_type, scene_id, anchors FROM c WHERE split = 'train' INTERSECT SELECT question_type, scene_id, anchors FROM c WHERE split <> 'train'
"""


def degenerate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of suppliers whose tax takes at least nine values."""
    out = splits.varied_keys(table(spark, folder, "lineitem"), ["l_suppkey"], F.round("l_tax", 2), 9)
    return out.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


DEGENERATE_SQL = "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT round(l_tax, 2)) >= 9"


def _picked_clips(spark: SparkSession, folder: str) -> DataFrame:
    return last_wins(table(spark, folder, "clips"), ["clip_id"], "ingested_at", ["group_id", "trajectory", "direction", "variation_tag", "quality_score"])


def greedy_group_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Six clips of each group, each the one whose trajectory, direction and tag are used least so far, then the best."""
    return greedy.clips_of_group(_picked_clips(spark, folder), "group_id", "clip_id", ["trajectory", "direction", "variation_tag"], "quality_score", 6)


GROUP_CLIPS_SQL = """
    WITH RECURSIVE c AS (
        SELECT clip_id, group_id, coalesce(trajectory, '~') AS t, coalesce(direction, '~') AS d, coalesce(variation_tag, '~') AS v, CASE WHEN NOT isnan(quality_score) THEN quality_score END AS q
        FROM clips QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC) = 1
    ), r AS (
        SELECT group_id, 0 AS position, []::VARCHAR[] AS ids, []::VARCHAR[] AS seen FROM c GROUP BY group_id
        UNION ALL
        SELECT group_id, position + 1, list_append(ids, pick.clip_id), list_concat(seen, ['t' || pick.t, 'd' || pick.d, 'v' || pick.v]) FROM (
            SELECT r.group_id, r.position, r.ids, r.seen,
                arg_min(c, (len(list_filter(r.seen, lambda x: x = 't' || c.t)) + len(list_filter(r.seen, lambda x: x = 'd' || c.d)) + len(list_filter(r.seen, lambda x: x = 'v' || c.v)), c.q IS NULL, -coalesce(c.q, 0), c.clip_id)) AS pick
            FROM r JOIN c ON r.group_id = c.group_id AND NOT list_contains(r.ids, c.clip_id) WHERE r.position < 6 GROUP BY ALL)
    )
    SELECT group_id, ids[-1] AS clip_id, CAST(position AS INT) AS position FROM r WHERE position > 0
"""


def greedy_scene_passes(spark: SparkSession, folder: str) -> DataFrame:
    """Five orders of each customer: a kind each, then new days of the month, then the rest."""
    orders = table(spark, folder, "orders").withColumn("day", F.dayofmonth("o_orderdate"))
    return greedy.scene_three_passes(orders, "o_custkey", "o_orderkey", ["o_orderpriority", "o_orderstatus"], "day", "o_totalprice", 5)


PASSES_SQL = """
    WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice AS p, day(o_orderdate) AS d, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders),
    one AS (SELECT * FROM o WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderkey) <= 5),
    rest AS (SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM one)),
    ranked AS (SELECT 0 AS rule, o_custkey, o_orderkey, p FROM one UNION ALL
        SELECT CASE WHEN row_number() OVER (PARTITION BY o_custkey, d ORDER BY p DESC, o_orderkey) = 1 AND (o_custkey, d) NOT IN (SELECT (o_custkey, d) FROM one) THEN 1 ELSE 2 END, o_custkey, o_orderkey, p FROM rest)
    SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY rule, p DESC, o_orderkey) AS INT) AS position FROM ranked QUALIFY position <= 5
"""


def greedy_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """150 parts, types and brands used evenly, at most five of a brand and thirty of a type as long as that goes."""
    ids = greedy.balanced_under_caps(table(spark, folder, "part"), "p_partkey", "p_brand", "p_type", 150, 5, 30)
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(ids)], "p_partkey bigint, position int")


#: State: the picked keys and, for each, its brand and type. ``closed`` gives up the brand cap, then both, where no candidate is left.
BALANCED_SQL = """
    WITH RECURSIVE p AS (SELECT p_partkey, p_brand AS b, p_type AS t FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey::VARCHAR) <= 150),
    r AS (
        SELECT 0 AS n, []::BIGINT[] AS ids, []::VARCHAR[] AS bs, []::VARCHAR[] AS ts
        UNION ALL
        SELECT n + 1, list_append(ids, x.p_partkey), list_append(bs, x.b), list_append(ts, x.t) FROM (
            SELECT n, ids, bs, ts, arg_min(p, (CASE WHEN ub < 5 AND ut < 30 THEN 0 WHEN ut < 30 THEN 1 ELSE 2 END, ut, ub, p_partkey::VARCHAR)) AS x
            FROM (SELECT r.*, p, p.p_partkey, len(list_filter(bs, lambda v: v = p.b)) AS ub, len(list_filter(ts, lambda v: v = p.t)) AS ut FROM r, p WHERE n < 150 AND NOT list_contains(ids, p.p_partkey))
            GROUP BY n, ids, bs, ts)
    )
    SELECT ids[-1] AS p_partkey, CAST(n AS INT) AS position FROM r WHERE n > 0
"""


def greedy_novelty(spark: SparkSession, folder: str) -> DataFrame:
    """60 parts, each the one with the newest brand, words of its name, and type."""
    rows = table(spark, folder, "part").withColumn("words", F.split("p_name", " "))
    ids = greedy.novelty_pick(rows, "p_partkey", "p_brand", "words", "p_type", 60)
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(ids)], "p_partkey bigint, position int")


NOVELTY_SQL = """
    WITH RECURSIVE p AS (SELECT p_partkey, p_brand AS b, p_type AS t, string_split(p_name, ' ') AS w FROM part),
    r AS (
        SELECT 0 AS n, []::BIGINT[] AS ids, []::VARCHAR[] AS bs, []::VARCHAR[] AS ts, []::VARCHAR[] AS ws
        UNION ALL
        SELECT n + 1, list_append(ids, x.p_partkey), list_append(bs, x.b), list_append(ts, x.t), list_concat(ws, x.w) FROM (
            SELECT n, ids, bs, ts, ws, arg_min(p, (-(1000 * (NOT list_contains(bs, p.b))::INT + 50 * len(list_filter(list_distinct(p.w), lambda v: NOT list_contains(ws, v))) + 10 * (NOT list_contains(ts, p.t))::INT), p.p_partkey::VARCHAR)) AS x
            FROM r, p WHERE n < 60 AND NOT list_contains(ids, p.p_partkey) GROUP BY n, ids, bs, ts, ws)
    )
    SELECT ids[-1] AS p_partkey, CAST(n AS INT) AS position FROM r WHERE n > 0
"""


def _candidate_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Groups as candidates: their newest delivery, one label key, and how many clips they have."""
    groups = table(spark, folder, "consistency_groups").withColumn("at", F.struct("ingested_at", F.size("clip_ids")))
    groups = last_wins(groups, ["group_id"], "at", ["question_type", "scene_id", "room_bucket", "motion_family", "dimension", "radius", "anchor_labels", "anchor_ids", "shared_ground_truth", "clip_ids"])
    prior = table(spark, folder, "candidate_groups").groupBy("group_id").agg(F.max("from_eval_plan").alias("prior"))
    labels = reshape.atomic_labels(F.coalesce("anchor_labels", F.array().cast("array<string>")))
    return groups.join(prior, "group_id", "left").select(
        "group_id", "question_type", "scene_id", "room_bucket", "dimension", "radius", "motion_family", F.col("shared_ground_truth").alias("answer"), F.concat_ws("|", F.array_sort("anchor_ids")).alias("anchor"),
        labels.alias("labels"), F.concat_ws("|", labels).alias("label"), F.when(F.col("prior"), 0).otherwise(1).alias("fresh"), F.size("clip_ids").alias("clips"),
    )


GREEDY_COLUMNS = greedy.GroupColumns("group_id", "question_type", "scene_id", "label", "labels", "room_bucket", "motion_family", "answer", "anchor", "dimension", "fresh", "clips")
FAMILY_TARGETS = {"object_dimensions": 24, "object_distance_to_camera": 20, "object_pair_distance_center": 12}


def greedy_families(spark: SparkSession, folder: str) -> DataFrame:
    """Up to 56 groups, of each family a quarter of its groups at most, balanced over families, scenes, labels and more; no single label more than twelve times."""
    rows = _candidate_columns(spark, folder)
    words = [r[0] for r in rows.select(F.explode("labels")).distinct().collect()]  # label words
    there = {r[0]: r[1] for r in rows.groupBy("question_type").agg(F.count(F.lit(1))).collect()}
    targets = {k: min(n, there.get(k, 0) // 4) for k, n in FAMILY_TARGETS.items()}
    out = greedy.family_balanced(rows, GREEDY_COLUMNS, targets, label_caps=dict.fromkeys(words, 12))
    return spark.createDataFrame(out, "group_id string, question_type string, position int")


def greedy_targets(spark: SparkSession, folder: str) -> DataFrame:
    """One group for each of ninety targets, five rounds over the eighteen commonest settings of motion, question and dimension, the used labels, scenes and rooms last."""
    rows = _candidate_columns(spark, folder).withColumn("tie", F.conv(F.substring(F.md5("group_id"), 1, 8), 16, 10).cast("bigint"))
    match = ["motion_family", "question_type", "dimension"]
    kinds = rows.groupBy(*match).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *match).limit(18).collect()
    targets = [tuple(r[m] for m in match) for _ in range(5) for r in kinds if r["n"] >= 5]
    out = greedy.pick_for_targets(rows, "group_id", match, targets, "labels", "scene_id", "room_bucket", ["tie"])
    return spark.createDataFrame(out, "group_id string, position int")


def greedy_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve parts for each container size bucket, at most two of a brand and eight of a type as long as that goes."""
    parts = table(spark, folder, "part").withColumn("bucket", F.floor(F.col("p_size") / 10).cast("int"))
    out = greedy.bucket_passes(parts, "p_partkey", "bucket", [0, 1, 2, 3, 4], "p_brand", "p_type", 12, 2, 8)
    return spark.createDataFrame(out, "p_partkey bigint, bucket int, position int")


def fair_motion_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Max-min fair shares of 700 groups over the motions as they are written, each at most what there is; and equal demands with the shortfall handed round."""
    there = {r[0]: r[1] for r in table(spark, folder, "consistency_groups").where("motion_family is not null").groupBy("motion_family").agg(F.count(F.lit(1))).collect()}
    fair, equal = windows.fair_targets(there, 700), greedy.adaptive_targets(there, 700)
    return spark.createDataFrame([(k, n, fair[k], equal[k]) for k, n in there.items()], "motion_family string, available bigint, fair bigint, equal bigint")


#: The level at which min(n, level) over all names adds up to 700 or less; the rest goes one by one to the first names that have room.
FAIR_SQL = """
    WITH c AS (SELECT motion_family, count(*) AS n FROM consistency_groups WHERE motion_family IS NOT NULL GROUP BY 1), tot AS (SELECT least(700, sum(n)) AS total FROM c),
    l AS (SELECT max(level) AS level FROM (SELECT level, sum(least(n, level)) AS filled FROM c, (SELECT unnest(range(0, 701)) AS level) GROUP BY 1) WHERE filled <= (SELECT total FROM tot)),
    f AS (SELECT *, least(n, level) AS base, CASE WHEN n > level THEN row_number() OVER (PARTITION BY n > level ORDER BY motion_family) END AS turn FROM c, l),
    g AS (SELECT motion_family, n AS available, CAST(base + CASE WHEN turn <= (SELECT total - (SELECT sum(base) FROM f) FROM tot) THEN 1 ELSE 0 END AS BIGINT) AS fair FROM f)
    SELECT *, fair AS equal FROM g
"""


def sharded_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with the shard, of eight, that their lines are worked on by: largest first, to the shard with the least so far; and the load of it."""
    sizes = {r[0]: r[1] for r in table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1))).collect()}
    shard = greedy.longest_first_shards(sizes, 8)
    rows = spark.createDataFrame([(k, sizes[k], v) for k, v in shard.items()], "l_suppkey bigint, n bigint, shard bigint")
    return rows.withColumn("load", F.sum("n").over(Window.partitionBy("shard")))


SHARDS_SQL = """
    WITH RECURSIVE s AS (SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS i FROM lineitem GROUP BY 1),
    r AS (
        SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS load, -1::BIGINT AS shard
        UNION ALL
        SELECT s.i, list_transform(load, lambda v, j: v + CASE WHEN j = list_position(load, list_min(load)) THEN s.n ELSE 0 END), list_position(load, list_min(load)) - 1 FROM r JOIN s ON s.i = r.i + 1
    ), f AS (SELECT load FROM r ORDER BY i DESC LIMIT 1)
    SELECT l_suppkey, n, r.shard::BIGINT AS shard, f.load[r.shard + 1]::BIGINT AS load FROM r JOIN s USING (i), f
"""


def relaxed_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The widest price tolerance of a schedule that is needed until 400 parts lie within it of their type's mean price, and the parts then selected."""
    parts = table(spark, folder, "part").withColumn("off", F.round(F.abs(F.col("p_retailprice") - F.avg("p_retailprice").over(Window.partitionBy("p_type"))), 4))
    found, used = greedy.relax_until([1.0, 5.0, 20.0, 50.0, 200.0, 1000.0], lambda w: parts.where(F.col("off") <= w).select("p_partkey").collect(), lambda rows: len(rows) >= 400)
    return spark.createDataFrame([(r[0], used) for r in found], "p_partkey bigint, tolerance double")


RELAXED_SQL = """
    WITH p AS (SELECT p_partkey, round(abs(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_type)), 4) AS off FROM part),
    w AS (SELECT w, row_number() OVER (ORDER BY w) AS i, (SELECT count(*) FROM p WHERE off <= w) AS n FROM (SELECT unnest([1.0, 5.0, 20.0, 50.0, 200.0, 1000.0]::DOUBLE[]) AS w)),
    stop AS (SELECT min(i) AS i FROM (SELECT i FROM w WHERE n >= 400 UNION ALL SELECT i - 1 FROM (SELECT i, n, lag(n) OVER (ORDER BY i) AS before FROM w) WHERE n <= before UNION ALL SELECT max(i) FROM w))
    SELECT p_partkey, w.w AS tolerance FROM p, w JOIN stop USING (i) WHERE off <= w.w
"""


HAMMING_DEDUP_SQL = """
    WITH RECURSIVE b AS (SELECT vec_id, label, list_sum(list_transform(range(0, 62), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS bits, embedding[64]::DOUBLE AS q FROM embeddings),
    o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY q DESC, vec_id) AS i FROM b),
    r AS (
        SELECT label, 0::BIGINT AS i, []::BIGINT[] AS ids, []::BIGINT[] AS kept FROM o GROUP BY label
        UNION ALL
        SELECT label, i, CASE WHEN fits THEN list_append(ids, vec_id) ELSE ids END, CASE WHEN fits THEN list_append(kept, bits) ELSE kept END FROM (
            SELECT r.label, o.i, r.ids, r.kept, o.vec_id, o.bits, len(r.ids) < 10 AND len(list_filter(r.kept, lambda k: bit_count(xor(k, o.bits)) < 24)) = 0 AS fits FROM r JOIN o ON o.label = r.label AND o.i = r.i + 1)
    ), final AS (SELECT label, arg_max(ids, i) AS ids FROM r GROUP BY 1)
    SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY NOT list_contains(ids, vec_id), i) AS INT) AS position FROM o JOIN final USING (label) QUALIFY position <= 10
"""


def gt_diverse(spark: SparkSession, folder: str) -> DataFrame:
    """Five groups per answer value of each question type, scenes in turn."""
    groups = table(spark, folder, "consistency_groups").where("scene_id is not null and shared_ground_truth is not null")
    groups = groups.groupBy("question_type", "shared_ground_truth", "group_id").agg(F.min("scene_id").alias("scene_id"))
    first = windows.top_k(groups, ["question_type", "shared_ground_truth", "scene_id"], ["group_id"], 5, "in_scene")
    out = windows.top_k(first, ["question_type", "shared_ground_truth"], ["in_scene", "scene_id", "group_id"], 5)
    return out.select("question_type", "shared_ground_truth", "group_id", F.col("position").cast("bigint").alias("position"))


GT_SQL = """
    WITH g AS (SELECT question_type, shared_ground_truth, group_id, min(scene_id) AS scene_id FROM consistency_groups WHERE scene_id IS NOT NULL AND shared_ground_truth IS NOT NULL GROUP BY 1, 2, 3),
    s AS (SELECT *, row_number() OVER (PARTITION BY question_type, shared_ground_truth, scene_id ORDER BY group_id) AS i FROM g)
    SELECT question_type, shared_ground_truth, group_id, row_number() OVER (PARTITION BY question_type, shared_ground_truth ORDER BY i, scene_id, group_id) AS position FROM s QUALIFY position <= 5
"""


def catalog() -> dict:
    return {
        "topk_two_pass_diverse": (topk_two_pass_diverse, TWO_PASS_SQL),
        "k_per_stratum": (k_per_stratum, "SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS position FROM part QUALIFY position <= 3"),
        "water_fill": (water_fill, WATER_SQL),
        "hierarchical_fill": (hierarchical_fill, FILL_SQL),
        "bucket_cap_running": (bucket_cap_running, CAP_SQL),
        "interleave": (interleave, INTERLEAVE_SQL),
        "even_fill_quota": (even_fill_quota, EVEN_SQL),
        "even_positions": (even_angles, EVEN_ANGLES_SQL),
        "consecutive_dedup": (consecutive_dedup, DEDUP_SQL),
        "islands": (islands, ISLANDS_SQL),
        "arc_segments": (arc_segments, ARCS_SQL),
        "monotonic_fraction": (monotonic_fraction, MONOTONIC_SQL),
        "bounce_sequence": (bounce_sequence, BOUNCE_SQL),
        "hamming_distances": (hamming_distances, HAMMING_SQL),
        "hamming_dedup": (hamming_dedup, HAMMING_DEDUP_SQL),
        "ood_split": (ood_split, OOD_SQL),
        "leak_free_split": (leak_free_split, LEAK_SQL),
        "shared_split_keys": (shared_split_keys, SHARED_SQL),
        "degenerate_keys": (degenerate_keys, DEGENERATE_SQL),
        "gt_diverse": (gt_diverse, GT_SQL),
        "greedy_group_clips": (greedy_group_clips, GROUP_CLIPS_SQL),
        "greedy_scene_passes": (greedy_scene_passes, PASSES_SQL),
        "greedy_balanced": (greedy_balanced, BALANCED_SQL),
        "greedy_novelty": (greedy_novelty, NOVELTY_SQL),
        "greedy_families": (greedy_families, None),
        "greedy_targets": (greedy_targets, None),
        "greedy_buckets": (greedy_buckets, None),
        "fair_targets": (fair_motion_targets, FAIR_SQL),
        "longest_first_shards": (sharded_scenes, SHARDS_SQL),
        "relaxed_selection": (relaxed_selection, RELAXED_SQL),
    }
