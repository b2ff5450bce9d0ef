"""Queries on shape: flatten, nest, route, joins, set operations and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import arrays, text
from evalloom.operators import breakdown, distribution, generation, joins, reshape, windows
from evalloom.plans.tables import r, table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _nested_orders(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))
    nested = reshape.nest(lines, ["l_orderkey"], "l_linenumber", ["l_linenumber", "l_quantity", "l_returnflag"], "questions")
    return table(spark, folder, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")


def flatten_qa(spark: SparkSession, folder: str) -> DataFrame:
    """Order records with a list of lines, nested and flattened again; orders without lines give no row."""
    return reshape.flatten(_nested_orders(spark, folder), ["o_orderkey", "o_orderstatus"], "questions")


FLATTEN_SQL = """SELECT o_orderkey, o_orderstatus, l_linenumber, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"""


def nest_qa(spark: SparkSession, folder: str) -> DataFrame:
    out = _nested_orders(spark, folder)
    return out.select("o_orderkey", F.size(F.coalesce("questions", F.array())).cast("bigint").alias("questions"), F.concat_ws(",", F.transform("questions", lambda q: q["l_linenumber"].cast("string"))).alias("numbers"))


NEST_SQL = """SELECT o_orderkey, count(DISTINCT l_linenumber) AS questions, coalesce(string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR), '') AS numbers
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""


def vector_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("vec_id"), F.transform("embedding", lambda x: r(x.cast("double"))).alias("v"))
    return reshape.split_vector(rows, F.col("v"), ["length", "width", "height"], "vec_id").drop("v")


VECTOR_SQL = " UNION ALL ".join(f"SELECT vec_id || '__dim_{n}' AS vec_id, round(embedding[{i + 1}]::DOUBLE, 6) AS value, '{n}' AS dimension FROM embeddings" for i, n in enumerate(("length", "width", "height")))


def curate_edit(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    path = reshape.route(F.col("o_orderstatus"), {"F": F.concat(F.lit("/old/"), key), "O": F.concat(F.lit("/new/"), key), "P": F.concat(F.lit("/both/"), key)})
    kept = reshape.remap_prefix(path, "/old/", "/archive/")
    return table(spark, folder, "orders").select("o_orderkey", kept.alias("path"), reshape.path_part(path, "b").alias("part"), reshape.replace_first(F.col("o_orderpriority"), "-", ": ").alias("priority"))


CURATE_SQL = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '/archive/' WHEN 'O' THEN '/new/' ELSE '/both/' END || o_orderkey AS path,
    CASE WHEN o_orderstatus = 'P' THEN 'both' END AS part,
    split_part(o_orderpriority, '-', 1) || ': ' || substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS priority FROM orders"""


def normalised_union(spark: SparkSession, folder: str) -> DataFrame:
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    return reshape.normalise_union([
        (c, {"kind": F.lit("customer"), "id": F.col("c_custkey"), "balance": F.col("c_acctbal"), "segment": F.col("c_mktsegment")}), (s, {"kind": F.lit("supplier"), "id": F.col("s_suppkey"), "balance": F.col("s_acctbal")})
    ])


NORMALISED_SQL = "SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier"


def group_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys, labels and tags of the consistency groups."""
    g = table(spark, folder, "consistency_groups")
    labels = F.coalesce("anchor_labels", F.array().cast("array<string>"))
    return g.select(
        "group_id", "ingested_at", reshape.label_key(labels).alias("label_key"), reshape.anchor_key(F.col("anchor_ids")).alias("anchor_key"),
        F.concat_ws(",", reshape.atomic_labels(labels)).alias("atomic"), reshape.group_key(F.col("engine"), F.col("question_type"), F.col("dimension")).alias("key"), reshape.decimal_tag(F.col("radius")).alias("tag"),
    ).distinct()


KEYS_SQL = """
    WITH g AS (SELECT *, list_filter(list_transform(coalesce(anchor_labels, []), lambda x: trim(split_part(x, '|', 1))), lambda x: x <> '') AS l FROM consistency_groups)
    SELECT DISTINCT group_id, ingested_at, array_to_string(list_sort(l[1:2]), '–') AS label_key, array_to_string(list_sort(anchor_ids), '|') AS anchor_key,
        array_to_string(list_sort(list_distinct(l)), ',') AS atomic, concat_ws('_', engine, question_type, dimension) AS key, replace(format('{:.1f}', radius), '.', 'p') AS tag FROM g
"""


def question_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of the clips: questions asked about an image, shortened, with the parts of their tags."""
    tag = text.variation_parts(F.col("variation_tag"))
    prompt = text.compose_prompt(F.col("question"), "Watch.", "Answer with one number.")
    return table(spark, folder, "clips").select(
        "clip_id", text.for_image(prompt).alias("prompt"), text.shortened(F.col("question"), 40).alias("short"), tag["cycles"].alias("cycles"), tag["kind"].alias("kind"), tag["degrees"].alias("degrees"),
        text.motion_of(F.col("variation_tag")).alias("motion"), text.before_marker(F.col("question"), "Reply").alias("head"), text.engine_of(F.col("engine"), F.col("scene_id")).alias("engine"),
    ).distinct()


QUESTION_SQL = r"""
    SELECT DISTINCT clip_id, regexp_replace('Watch. ' || trim(question) || ' Answer with one number.', '(?i)\bin (?:this|the) (?:video|clip)\b', 'in this image', 'g') AS prompt,
        CASE WHEN length(question) > 40 THEN rtrim(substr(question, 1, 39)) || '…' ELSE question END AS short,
        try_cast(nullif(regexp_extract(variation_tag, '^([0-9]+)x_(start|angle)([0-9]+)$', 1), '') AS INT) AS cycles, nullif(regexp_extract(variation_tag, '^([0-9]+)x_(start|angle)([0-9]+)$', 2), '') AS kind,
        try_cast(nullif(regexp_extract(variation_tag, '^([0-9]+)x_(start|angle)([0-9]+)$', 3), '') AS INT) AS degrees, 'other' AS motion, rtrim(split_part(question, 'Reply', 1)) AS head, lower(trim(engine)) AS engine
    FROM clips
"""


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Training conversations built from the clips, and their statistics."""
    clips = table(spark, folder, "clips").withColumn("conversations", reshape.conversation(F.col("question"), F.coalesce("ground_truth", F.lit("")), "<video>"))
    out = distribution.conversation_stats(clips, "conversations", F.col("engine"))
    return out.select("modality", "n", "turns", "answers", r("mean_answer_chars").alias("mean_answer_chars"))


CONVERSATIONS_SQL = "SELECT engine AS modality, count(*) AS n, CAST(2 * count(*) AS BIGINT) AS turns, count(*) AS answers, round(avg(length(coalesce(ground_truth, ''))), 6) AS mean_answer_chars FROM clips GROUP BY 1"


def array_predicates(spark: SparkSession, folder: str) -> DataFrame:
    known = arrays.literal(["Sideboard", "Armchair", "Bookcase"])
    labels = F.col("anchor_labels")
    return table(spark, folder, "clips").where(labels.isNotNull()).groupBy(arrays.subset(labels, known).alias("subset"), arrays.disjoint(labels, known).alias("disjoint"), arrays.any_in(labels, ["Sideboard"]).alias("any")).agg(F.count(F.lit(1)).alias("n"))


PREDICATES_SQL = """SELECT len(list_filter(anchor_labels, lambda x: NOT list_contains(['Sideboard', 'Armchair', 'Bookcase'], x))) = 0 AS subset,
    len(list_intersect(anchor_labels, ['Sideboard', 'Armchair', 'Bookcase'])) = 0 AS disjoint, list_contains(anchor_labels, 'Sideboard') AS "any", count(*) AS n
    FROM clips WHERE anchor_labels IS NOT NULL GROUP BY 1, 2, 3"""


def question_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """What the questions of training conversations ask about, read from their words, and the views that tasks vary."""
    talk = reshape.conversation(F.col("question"), F.coalesce("ground_truth", F.lit("")))
    task = F.when(F.col("engine") == "thor", "video").otherwise("edit")
    tasks = {"video": ("video_view", text.camera_variation(F.col("motion_family"))), "edit": ("scene_edit", text.scene_edit(F.lit("rotate")))}
    clips = table(spark, folder, "clips").select(text.question_kind(text.asked(talk)).alias("kind"), reshape.route(task, {k: F.lit(v[0]) for k, v in tasks.items()}).alias("bucket"), reshape.route(task, {k: v[1] for k, v in tasks.items()}).alias("pattern"))
    return clips.groupBy("kind", "bucket", "pattern").agg(F.count(F.lit(1)).alias("n"))


KINDS_SQL = """
    WITH q AS (SELECT lower(trim(question)) AS q, engine, motion_family AS m FROM clips)
    SELECT CASE WHEN contains(q, 'distance between') OR (contains(q, 'distance from') AND NOT contains(q, 'camera')) THEN 'pair_distance' WHEN contains(q, 'distance') AND contains(q, 'camera') THEN 'camera_distance'
        WHEN contains(q, 'width') OR contains(q, 'height') OR contains(q, 'length') THEN 'size' ELSE 'unknown' END AS kind, CASE WHEN engine = 'thor' THEN 'video_view' ELSE 'scene_edit' END AS bucket,
        CASE WHEN engine <> 'thor' THEN 'obj_rotation' WHEN m = 'rotation' THEN 'cam_rotation' ELSE m END AS pattern, count(*) AS n FROM q GROUP BY 1, 2, 3
"""


def covisible(spark: SparkSession, folder: str) -> DataFrame:
    """For each order the line numbers that all of its return flags share, and how many flags have both lines 1 and 2."""
    seen = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ids"))
    views = seen.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("ids")).alias("lists"), F.map_from_entries(F.collect_list(F.struct("l_returnflag", "ids"))).alias("frames"))
    common = F.array_sort(arrays.in_all(F.col("lists")))
    return views.select("l_orderkey", F.concat_ws(",", common).alias("common"), arrays.covisible_frames(F.array(F.lit(1), F.lit(2)), F.col("frames")).cast("bigint").alias("both"))


COVISIBLE_SQL = """
    WITH seen AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem), n AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS views FROM seen GROUP BY 1),
    c AS (SELECT l_orderkey, l_linenumber, count(*) AS k FROM seen GROUP BY 1, 2), f AS (SELECT l_orderkey, l_returnflag FROM seen WHERE l_linenumber IN (1, 2) GROUP BY 1, 2 HAVING count(*) = 2)
    SELECT n.l_orderkey, coalesce((SELECT string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FROM c WHERE c.l_orderkey = n.l_orderkey AND k = views), '') AS common,
        (SELECT count(*) FROM f WHERE f.l_orderkey = n.l_orderkey) AS both FROM n
"""


def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return joins.last_wins(orders, ["o_custkey"], "at", ["o_orderkey", "o_totalprice"])


LATEST_SQL = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def first_per_key(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return joins.first_wins(orders, ["o_custkey"], "at", ["o_orderkey", "o_totalprice"])


def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of groups that are candidates."""
    wanted = table(spark, folder, "candidate_groups").select("group_id")
    return table(spark, folder, "consistency_groups").join(wanted, "group_id", "left_semi").select("group_id", "ingested_at")


def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of groups that are not."""
    wanted = table(spark, folder, "candidate_groups").select("group_id")
    return table(spark, folder, "consistency_groups").join(wanted, "group_id", "left_anti").select("group_id", "ingested_at")


REUSE = ["motion_family", "question_type", "dimension", "radius"]


def nullsafe_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Per engine, the share of clips whose setting (null equals null) occurs among the groups."""
    out = joins.reuse_ratio(table(spark, folder, "clips"), table(spark, folder, "consistency_groups"), "engine", REUSE)
    return out.select("engine", "wanted", "reused", r("ratio").alias("ratio"))


REUSE_SQL = f"""
    WITH g AS (SELECT DISTINCT {", ".join(REUSE)} FROM consistency_groups)
    SELECT engine, count(*) AS wanted, count(g.question_type) AS reused, round(count(g.question_type) / count(*), 6) AS ratio
    FROM clips c LEFT JOIN g ON {" AND ".join(f"c.{x} IS NOT DISTINCT FROM g.{x}" for x in REUSE)} GROUP BY 1
"""


def ordered_children(spark: SparkSession, folder: str) -> DataFrame:
    """Clips of each group in the order of its list of clip ids."""
    groups = table(spark, folder, "consistency_groups").withColumn("at", F.struct("ingested_at", F.size("clip_ids")))
    groups = joins.last_wins(groups, ["group_id"], "at", ["clip_ids"])
    clips = joins.last_wins(table(spark, folder, "clips"), ["clip_id"], "ingested_at", ["batch_no"])
    out = joins.ordered_children(groups, "group_id", "clip_ids", clips, "clip_id", ["batch_no"])
    return out.withColumn("position", F.col("position").cast("bigint"))


CHILDREN_SQL = """
    WITH g AS (SELECT group_id, clip_ids FROM consistency_groups QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY ingested_at DESC, len(clip_ids) DESC) = 1),
    c AS (SELECT clip_id, batch_no FROM clips QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC) = 1),
    e AS (SELECT group_id, unnest(clip_ids) AS clip_id, generate_subscripts(clip_ids, 1) - 1 AS position FROM g)
    SELECT group_id, position, clip_id, batch_no FROM e JOIN c USING (clip_id)
"""


def pair_theta_join(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier pairs of one nation whose balances differ by at most 500 and by less than half of the larger one."""
    low, high = F.least("value_a", "value_b"), F.greatest("value_a", "value_b")
    out = joins.band_pairs(table(spark, folder, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", 500.0, (low > 0) & (low / high > 0.5))
    return out.select("s_nationkey", "id_a", "id_b")


THETA_SQL = """SELECT a.s_nationkey, a.s_suppkey AS id_a, b.s_suppkey AS id_b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
    WHERE abs(a.s_acctbal - b.s_acctbal) <= 500 AND least(a.s_acctbal, b.s_acctbal) > 0 AND least(a.s_acctbal, b.s_acctbal) / greatest(a.s_acctbal, b.s_acctbal) > 0.5"""


def nearest_neighbor(spark: SparkSession, folder: str) -> DataFrame:
    """For every customer the supplier of the same nation with the nearest balance."""
    out = joins.nearest_on_line(table(spark, folder, "customer").withColumnRenamed("c_nationkey", "nation"), "c_custkey", "c_acctbal", table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "nation"), "s_suppkey", "s_acctbal", ["nation"])
    return out.select("nation", "c_custkey", "s_suppkey", r("distance", 4).alias("distance"))


NEAREST_SQL = """SELECT c_nationkey AS nation, c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 4) AS distance FROM customer JOIN supplier ON c_nationkey = s_nationkey
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_acctbal, s_suppkey) = 1"""


def _part_boxes(parts: DataFrame) -> DataFrame:
    return parts.select("p_partkey", (F.col("p_size") * 3.0).alias("value_min"), (F.col("p_size") * 3.0 + 0.5).alias("value_max"), F.lit(10.0).alias("k_min"), (F.lit(10.0) + F.col("p_partkey") % 7).alias("k_max"))


def _box_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def box_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the boxes that parts span over value and key of the event. Parts of one size and key range span the same box, so events meet each distinct box once."""
    extents = ["value_min", "value_max", "k_min", "k_max"]
    boxes = _part_boxes(table(spark, folder, "part")).withColumn("box", F.struct(*extents))
    counts = joins.in_boxes(_box_events(spark, folder), ["value", "k"], boxes.select("box", *extents).distinct(), "box", 1.0).groupBy("box").agg(F.count(F.lit(1)).alias("events"))
    return boxes.select("p_partkey", "box").join(counts, "box").select("p_partkey", "events")


BOX_SQL = """
    WITH b AS (SELECT DISTINCT p_size * 3.0 AS lo, 10 + p_partkey % 7 AS top FROM part), e AS (SELECT value, CAST(props->>'$.k' AS DOUBLE) AS k FROM events),
    n AS (SELECT lo, top, count(*) AS events FROM b JOIN e ON value BETWEEN lo AND lo + 0.5 AND k BETWEEN 10 AND top GROUP BY 1, 2)
    SELECT p_partkey, events FROM part JOIN n ON p_size * 3.0 = lo AND 10 + p_partkey % 7 = top
"""


def pareto_frontier(spark: SparkSession, folder: str) -> DataFrame:
    each = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return joins.pareto_frontier(each, "l_suppkey", "price", "discount")


PARETO_SQL = """WITH s AS (SELECT l_suppkey, round(avg(l_extendedprice), 4) AS price, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1)
    SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.price >= a.price AND b.discount >= a.discount AND (b.price > a.price OR b.discount > a.discount))"""


def delta_report(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of mean values between two kinds of event, per user."""
    each = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    a, b = each.where("event_type = 'click'").alias("a"), each.where("event_type = 'error'").alias("b")
    return a.join(b, F.col("a.user_id") == F.col("b.user_id")).select(F.col("a.user_id").alias("user_id"), r(F.col("b.m") - F.col("a.m")).alias("delta"))


DELTA_SQL = "SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'error') - avg(value) FILTER (WHERE event_type = 'click'), 6) AS delta FROM events GROUP BY 1 HAVING delta IS NOT NULL"


def share_table(spark: SparkSession, folder: str) -> DataFrame:
    return distribution.share_table(table(spark, folder, "lineitem"), "l_returnflag")


def share_of_all(spark: SparkSession, folder: str) -> DataFrame:
    """Dimensions of the clips as shares of all clips, null ones included in the total only."""
    clips = table(spark, folder, "clips")
    return distribution.share_table(clips, "dimension", clips.count())


def joint_share(spark: SparkSession, folder: str) -> DataFrame:
    return distribution.joint_counts(table(spark, folder, "clips"), ["engine", "dimension"])


def distributions(spark: SparkSession, folder: str) -> DataFrame:
    return distribution.many_distributions(table(spark, folder, "clips"), ["engine", "question_type", "dimension", "split", "cycle_count", "anchor_kind"])


DISTRIBUTIONS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS key, {c}::VARCHAR AS value, count(*) AS n FROM clips WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("engine", "question_type", "dimension", "split", "cycle_count", "anchor_kind"))


def angle_bins(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "clips").groupBy(distribution.angle_bin(F.col("start_angle_offset")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


BINS_SQL = """SELECT format('{:03d}-{:03d}', b, b + 29) AS bin, count(*) AS n FROM (
    SELECT CAST(floor((start_angle_offset - 360 * floor(start_angle_offset / 360)) / 30) * 30 AS INT) AS b FROM clips) GROUP BY 1"""


def top_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "clips").select("question_type", F.explode("anchor_labels").alias("label"))
    return distribution.top_per_group(labels, ["question_type"], "label", 15).withColumn("position", F.col("position").cast("bigint"))


TOP_SQL = """SELECT question_type, label, n, row_number() OVER (PARTITION BY question_type ORDER BY n DESC, label) AS position FROM (
    SELECT question_type, label, count(*) AS n FROM (SELECT question_type, unnest(anchor_labels) AS label FROM clips) GROUP BY 1, 2) QUALIFY position <= 15"""


def crosstab_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of the customers by nation, nations without customers included."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return distribution.crosstab(table(spark, folder, "customer"), "c_nationkey", "c_mktsegment", nations, SEGMENTS)


CROSSTAB_SQL = "SELECT n_nationkey AS c_nationkey, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1"


def pivot_scores(spark: SparkSession, folder: str) -> DataFrame:
    return breakdown.pivot_table(table(spark, folder, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.round(F.avg("o_totalprice"), 3))


PIVOT_SQL = "SELECT o_orderpriority, " + ", ".join(f"round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 3) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1"


def set_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and the buyers named in orders: what set operations leave of the two."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"))
    parts = {"union": c.union(o).distinct(), "union_all": c.unionAll(o), "intersect": c.intersect(o), "except": c.exceptAll(o).distinct(), "except_all": o.exceptAll(c)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum("id").alias("total")).withColumn("op", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


SETS_SQL = """
    WITH c AS (SELECT c_custkey AS id FROM customer), o AS (SELECT o_custkey AS id FROM orders),
    u AS (SELECT 'union' AS op, id FROM (FROM c UNION FROM o) UNION ALL SELECT 'union_all', id FROM (FROM c UNION ALL FROM o) UNION ALL SELECT 'intersect', id FROM (FROM c INTERSECT FROM o)
        UNION ALL SELECT 'except', id FROM (FROM c EXCEPT FROM o) UNION ALL SELECT 'except_all', id FROM (FROM o EXCEPT ALL FROM c))
    SELECT ops.op, count(id) AS n, min(id) AS low, max(id) AS high, CAST(sum(id) AS BIGINT) AS total FROM (SELECT unnest(['union', 'union_all', 'intersect', 'except', 'except_all']) AS op) ops LEFT JOIN u USING (op) GROUP BY 1
"""


def group_reconstruction(spark: SparkSession, folder: str) -> DataFrame:
    """Orders rebuilt from their lines: first line's flag and the line numbers in order of shipping."""
    lines = table(spark, folder, "lineitem").withColumn("line", F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    out = reshape.reconstruct_groups(lines, "l_orderkey", F.col("l_shipdate"), ["l_returnflag"], "line")
    return out.select("l_orderkey", "n", F.concat_ws(" ", "members").alias("members"))


RECONSTRUCTION_SQL = "SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || '-' || l_partkey, ' ' ORDER BY l_shipdate, l_linenumber || '-' || l_partkey) AS members FROM lineitem GROUP BY 1"


def object_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as scene objects: the only one of their name in a brand, of usable size, of no skipped kind; with a question each."""
    kept = generation.usable_objects(table(spark, folder, "part"), "p_brand", "p_name", F.col("p_size"), 5, 40, ["red widget", "small ring"])
    return kept.select("p_partkey", generation.camera_question(F.col("p_name")).alias("question"))


OBJECTS_SQL = """SELECT p_partkey, 'How far is the ' || p_name || ' from the camera, in metres?' AS question FROM part WHERE p_size BETWEEN 5 AND 40 AND p_name NOT IN ('red widget', 'small ring')
    QUALIFY count(*) OVER (PARTITION BY p_brand, p_name) = 1"""


def size_questions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.concat(F.lit("box "), "label").alias("name"), *[F.round(F.abs(F.col("embedding")[i].cast("double")), 3).alias(d) for i, d in enumerate(("length", "width", "height"))])
    return generation.size_questions(e, ["vec_id"], "name", ["length", "width", "height"], 2)


SIZES_SQL = " UNION ALL ".join(f"SELECT vec_id, '{d}' AS dimension, 'What is the {d} of the box ' || label || ' in metres?' AS question, round(round(abs(embedding[{i + 1}]::DOUBLE), 3) + 1e-9, 2) AS answer FROM embeddings" for i, d in enumerate(("length", "width", "height")))


def pair_questions(spark: SparkSession, folder: str) -> DataFrame:
    return generation.pair_questions(table(spark, folder, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", 50.0, 400.0)


PAIRQ_SQL = """SELECT a.s_nationkey, a.s_suppkey AS id_a, b.s_suppkey AS id_b, 'How far apart are the ' || a.s_suppkey || ' and the ' || b.s_suppkey || ', in metres?' AS question,
    round(abs(a.s_acctbal - b.s_acctbal) + 1e-9, 1) AS answer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
    WHERE abs(a.s_acctbal - b.s_acctbal) BETWEEN 50 AND 400"""


def frequent_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers that occur together in at least two orders."""
    return generation.frequent_pairs(table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey", 2)


FREQUENT_SQL = """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS item_a, b.l_suppkey AS item_b, count(*) AS views FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
    GROUP BY 1, 2 HAVING count(*) >= 2"""


def paired_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the lines that apply to them: those shipped within 30 days."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate")
    out = generation.paired_entries(orders, lines, "k", F.abs(F.datediff(F.col("q.l_shipdate"), F.col("v.o_orderdate"))) <= 30)
    return out.groupBy(F.col("v.k").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))


PAIRED_SQL = "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) <= 30 GROUP BY 1"


def nearest_in_plane(spark: SparkSession, folder: str) -> DataFrame:
    """For each embedding (first two numbers) the nearest one of label 0."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    out = joins.nearest_in_plane(e, "vec_id", e.where("label = 0").withColumnRenamed("vec_id", "point"), "point", ["x", "y"], 0.05)
    return out.select("vec_id", "point", r("distance").alias("distance"))


PLANE_SQL = """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
    SELECT a.vec_id, b.vec_id AS point, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 6) AS distance FROM e a JOIN e b ON b.label = 0
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), b.vec_id) = 1"""


def scaled_means(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_discount").alias("rate"), F.col("l_quantity").alias("amount"), "l_linestatus")
    out = breakdown.scaled_means(lines, ["l_returnflag"], ["rate", "amount"], ["amount"], F.col("l_linestatus") == "F")
    return out.select("l_returnflag", "n", r("rate").alias("rate"), r("amount").alias("amount"))


def top_distinct(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.top_distinct(table(spark, folder, "part"), "p_type", "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 5)
    return out.select("p_type", "p_brand", "p_partkey", F.col("position").cast("bigint").alias("position"))


DISTINCT_SQL = """WITH b AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_partkey) = 1)
    SELECT p_type, p_brand, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS position FROM b QUALIFY position <= 5"""


def catalog() -> dict:
    return {
        "flatten_qa": (flatten_qa, FLATTEN_SQL),
        "nest_qa": (nest_qa, NEST_SQL),
        "vector_split": (vector_split, VECTOR_SQL),
        "curate_edit": (curate_edit, CURATE_SQL),
        "normalised_union": (normalised_union, NORMALISED_SQL),
        "group_keys": (group_keys, KEYS_SQL),
        "question_texts": (question_texts, QUESTION_SQL),
        "sft_stats": (conversations, CONVERSATIONS_SQL),
        "question_kinds": (question_kinds, KINDS_SQL),
        "array_predicates": (array_predicates, PREDICATES_SQL),
        "covisible": (covisible, COVISIBLE_SQL),
        "latest_per_key": (latest_per_key, LATEST_SQL),
        "first_per_key": (first_per_key, LATEST_SQL.replace("DESC", "ASC")),
        "semi_join": (semi_join, "SELECT group_id, ingested_at FROM consistency_groups WHERE group_id IN (SELECT group_id FROM candidate_groups)"),
        "anti_join": (anti_join, "SELECT group_id, ingested_at FROM consistency_groups WHERE group_id NOT IN (SELECT group_id FROM candidate_groups)"),
        "nullsafe_join": (nullsafe_reuse, REUSE_SQL),
        "ordered_children": (ordered_children, CHILDREN_SQL),
        "pair_theta_join": (pair_theta_join, THETA_SQL),
        "nearest_neighbor": (nearest_neighbor, NEAREST_SQL),
        "box_range_join": (box_range_join, BOX_SQL),
        "pareto_frontier": (pareto_frontier, PARETO_SQL),
        "delta_report": (delta_report, DELTA_SQL),
        "share_table": (share_table, "SELECT l_returnflag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM lineitem GROUP BY 1"),
        "share_of_all": (share_of_all, "SELECT dimension, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM clips), 1)::DOUBLE AS share FROM clips WHERE dimension IS NOT NULL GROUP BY 1"),
        "joint_share": (joint_share, "SELECT engine, dimension, count(*) AS n FROM clips WHERE engine IS NOT NULL AND dimension IS NOT NULL GROUP BY 1, 2"),
        "distributions": (distributions, DISTRIBUTIONS_SQL),
        "angle_bins": (angle_bins, BINS_SQL),
        "top_labels": (top_labels, TOP_SQL),
        "crosstab_pivot": (crosstab_pivot, CROSSTAB_SQL),
        "pivot_scores": (pivot_scores, PIVOT_SQL),
        "set_ops": (set_ops, SETS_SQL),
        "group_reconstruction": (group_reconstruction, RECONSTRUCTION_SQL),
        "object_selection": (object_selection, OBJECTS_SQL),
        "size_questions": (size_questions, SIZES_SQL),
        "pair_questions": (pair_questions, PAIRQ_SQL),
        "frequent_pairs": (frequent_pairs, FREQUENT_SQL),
        "paired_entries": (paired_entries, PAIRED_SQL),
        "nearest_in_plane": (nearest_in_plane, PLANE_SQL),
        "scaled_means": (scaled_means, "SELECT l_returnflag, count(*) AS n, round(100 * avg(l_discount), 6) AS rate, round(avg(l_quantity), 6) AS amount FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1"),
        "top_distinct": (top_distinct, DISTINCT_SQL),
    }
