"""SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from evalloom.llm.variety import projections

SCENE = "array_to_string(list_transform(regexp_extract_all(scene_id, '[0-9]+'), lambda x: regexp_replace(x, '^0+(.)', '\\1')), '_')"

P1_RANKED = f"""
    WITH now AS (
        SELECT clip_id, arg_max(struct_pack(g := group_id, s := {SCENE}, q := quality_score), ingested_at) AS r
        FROM clips GROUP BY clip_id
    ), own AS (
        SELECT group_id, min({SCENE}) AS gs FROM consistency_groups WHERE trim(scene_id) <> '' GROUP BY group_id
    ), placed AS (
        SELECT clip_id, coalesce(nullif(r.s, ''), gs) AS scene, r.q AS quality_score FROM now LEFT JOIN own ON r.g = group_id
    ), clean AS (
        SELECT clip_id, scene, CASE WHEN NOT isnan(quality_score) THEN quality_score END AS quality_score FROM placed
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY scene ORDER BY quality_score IS NULL, -quality_score, clip_id) AS n FROM clean
    ), keyed AS (
        SELECT *, CASE WHEN quality_score > 0 THEN ln(quality_score) - ln(-ln((CAST('0x' || substr(md5('reservoir17:' || clip_id), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)) END AS key FROM clean
    ), drawn AS (
        SELECT *, row_number() OVER (PARTITION BY scene ORDER BY key IS NULL, quality_score IS NULL, -coalesce(key, quality_score), clip_id) AS n FROM keyed
    )
"""

def _density_sql() -> str:
    """Settings, buckets and densities, with the projections of the operator written out."""
    families, ways = ("approach", "passby", "around", "spherical", "rotation"), ("cw", "ccw", "fw", "bw")
    turn = "radians(angle::DOUBLE)"
    features = [f"(family = '{x}')::INT * 4.0::DOUBLE" for x in families] + [f"(direction = '{x}')::INT * 2.0::DOUBLE" for x in ways]
    features += [f"cos({turn}) * 2.0::DOUBLE * (angle >= 0)::INT", f"sin({turn}) * 2.0::DOUBLE * (angle >= 0)::INT", "(angle >= 0)::INT * 4.0::DOUBLE", "cycles::DOUBLE"]
    lists = []
    for t, cells in enumerate(projections(len(features), 8, 4, 1.5, 5)):
        sums = [" + ".join([f"{shift!r}::DOUBLE", *[f"({x}) * {f!r}::DOUBLE" for x, f in zip(features, factors, strict=True)]]) for shift, factors in cells]
        lists.append(f"'{t}:' || concat_ws(',', {', '.join(f'floor(({x}) / 1.5)::BIGINT' for x in sums)})")

    def way(word: str) -> str:
        w = f"lower(regexp_replace({word}, '[^A-Za-z0-9]', '', 'g'))"
        rules = (("(counterclockwise|anticlockwise|ccw)$", "ccw"), ("(clockwise|cw)$", "cw"), ("(forwards?|fw)$", "fw"), ("(backwards?|bw)$", "bw"))
        return "CASE " + " ".join(f"WHEN regexp_matches({w}, '{a}') THEN '{b}'" for a, b in rules) + " END"

    kind = f"nullif(regexp_extract(lower(regexp_replace(trajectory, '[^A-Za-z0-9]', '', 'g')), '^({'|'.join(families)})', 1), '')"
    degrees = "round(start_angle_offset) - 360 * floor(round(start_angle_offset) / 360)"
    return f"""
        WITH now AS (
            SELECT clip_id, coalesce({kind}, 'other') AS family, coalesce({way("direction")}, {way("trajectory")}, 'unknown') AS direction,
                CASE WHEN isfinite(start_angle_offset) THEN CAST({degrees} AS INT) ELSE -1 END AS angle, greatest(coalesce(cycle_count, -1), -1) AS cycles
            FROM clips WHERE clip_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC) = 1
        ), settings AS (SELECT family, direction, angle, cycles, count(*) AS n FROM now GROUP BY ALL),
        buckets AS (SELECT family, direction, angle, cycles, n, unnest([{", ".join(lists)}]) AS b FROM settings),
        dense AS (SELECT family, direction, angle, cycles, avg(m) AS density FROM buckets JOIN (SELECT b, sum(n) AS m FROM buckets GROUP BY b) USING (b) GROUP BY ALL),
        keyed AS (
            SELECT clip_id, family, direction, angle, cycles, density,
                -ln((CAST('0x' || substr(md5('variety5:' || clip_id), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE) * density AS draw_key
            FROM now JOIN dense USING (family, direction, angle, cycles)
        ), drawn AS (SELECT *, row_number() OVER (ORDER BY draw_key, clip_id) <= (SELECT amount FROM plan_settings WHERE setting = 'varied_subset_size') AS drawn FROM keyed)
    """


P2_DRAWN = _density_sql()

CAP = "(SELECT amount FROM plan_settings WHERE setting = 'max_clips_per_scene')"

P5_PAIRS = f"""
    WITH now AS (
        SELECT clip_id, split, engine, question_type, coalesce(trim(dimension), '') AS dim, {SCENE} AS scene,
            array_to_string(list_sort(list_filter(list_transform(anchor_labels, lambda x: lower(regexp_replace(split_part(x, '|', 1), '[^A-Za-z0-9]', '', 'g'))), lambda x: x <> '')), '~') AS labels,
            CAST(regexp_extract(replace(ground_truth, ',', '.'), '[0-9]+([.][0-9]+)?') AS DOUBLE)
                / CASE WHEN ground_truth LIKE '%mm' THEN 1000 WHEN ground_truth LIKE '%cm' THEN 100 ELSE 1 END AS metres
        FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC) AS n FROM clips)
        WHERE n = 1 AND trim(scene_id) <> '' AND trim(ground_truth) <> ''
    ), pairs AS (
        SELECT e.clip_id AS eval_id, t.clip_id AS train_id, e.split, e.engine, t.engine AS train_engine
        FROM now e JOIN now t ON e.split <> 'train' AND t.split = 'train' AND e.scene = t.scene AND e.question_type = t.question_type
            AND e.dim = t.dim AND e.labels = t.labels AND e.labels <> '' AND round(abs(e.metres - t.metres), 9) < 0.15
    )
"""

MULTISET = "list_transform(string_split({x}, '~'), lambda v, i: v || len(list_filter(string_split({x}, '~')[1:i], lambda w: w = v)))"


HUBS = f"""
    links AS (
        SELECT DISTINCT group_id, unnest(list_concat(
            list_transform(list_filter(anchor_ids, lambda x: regexp_matches(x, '[^0-9A-Za-z][0-9A-Fa-f]{{8}}$')), lambda x: 'o' || lower(right(x, 8))),
            ['b' || regexp_extract(group_id, '^.*?_[0-9]{{8}}'), CASE WHEN trim(scene_id) <> '' THEN 's' || {SCENE} END])) AS hub
        FROM consistency_groups
    )
"""


def _category(column: str, axis: str) -> str:
    plain = f"lower(regexp_replace({column}, '[^A-Za-z0-9]', '', 'g'))"
    near = f"(SELECT category FROM sample_targets t WHERE t.axis = '{axis}' AND levenshtein(replace(category, '_', ''), {plain}) <= 2 ORDER BY levenshtein(replace(category, '_', ''), {plain}) LIMIT 1)"
    return f"CASE WHEN trim({column}) <> '' THEN {near} END"


P4_AVAILABLE = f"""
    WITH spelled AS (
        SELECT DISTINCT 'question_family' AS axis, question_family AS word FROM candidate_groups
        UNION SELECT 'room_bucket', room_bucket FROM consistency_groups UNION SELECT 'motion_family', motion_family FROM consistency_groups
    ), read AS (
        SELECT axis, word, CASE axis WHEN 'question_family' THEN {_category("word", "question_family")} WHEN 'room_bucket' THEN {_category("word", "room_bucket")}
            ELSE {_category("word", "motion_family")} END AS category
        FROM spelled WHERE trim(word) <> ''
    ), own AS (
        SELECT group_id, min(r.category) AS room, min(m.category) AS motion,
            min(CASE question_type WHEN 'object_dimensions' THEN 'size' WHEN 'object_distance_to_camera' THEN 'camera_distance' WHEN 'object_pair_distance_center' THEN 'pair_distance' END) AS typed
        FROM consistency_groups LEFT JOIN read r ON r.axis = 'room_bucket' AND r.word = room_bucket LEFT JOIN read m ON m.axis = 'motion_family' AND m.word = motion_family
        GROUP BY group_id
    ), groups AS (
        SELECT c.group_id, coalesce(min(q.category), min(typed)) AS family, min(room) AS room, min(motion) AS motion
        FROM candidate_groups c LEFT JOIN own USING (group_id) LEFT JOIN read q ON q.axis = 'question_family' AND q.word = question_family GROUP BY c.group_id
    ), counted AS (
        SELECT 'question_family' AS axis, family AS category FROM groups UNION ALL SELECT 'room_bucket', room FROM groups UNION ALL SELECT 'motion_family', motion FROM groups
    )
    SELECT t.axis, t.category, count(c.category) AS available
    FROM sample_targets t LEFT JOIN counted c ON t.axis = c.axis AND t.category = c.category GROUP BY t.axis, t.category
"""


P6_IDS = """
    WITH early AS (SELECT clip_id, group_id FROM clips WHERE batch_no <= (SELECT (min(batch_no) + max(batch_no)) / 2 FROM clips)), listed AS (
        SELECT 'clip' AS kind, clip_id AS ident, min(engine || '/' || question_type) AS stratum, clip_id IN (SELECT clip_id FROM early) AS early FROM clips GROUP BY clip_id
        UNION ALL SELECT 'group', group_id, min(engine || '/' || question_type), group_id IN (SELECT group_id FROM early) FROM consistency_groups GROUP BY group_id
    ), ids AS (
        SELECT *, CAST('0x' || substr(md5(kind || ':' || ident), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS place, (SELECT amount FROM plan_settings WHERE setting = 'stable_sample_share') AS share FROM listed
    )
"""


def llm_oracles() -> dict[str, str]:
    return {
        "p1_found": f"{P1_RANKED} SELECT clip_id FROM ranked WHERE scene IS NOT NULL AND n > {CAP}",
        "p1_capped_clips": f"{P1_RANKED} SELECT clip_id, scene, quality_score FROM ranked WHERE scene IS NULL OR n <= {CAP}",
        "p1_reservoir_clips": f"{P1_RANKED} SELECT clip_id, scene, quality_score, round(key, 6) AS reservoir_key FROM drawn WHERE scene IS NULL OR n <= {CAP}",
        "p1_scene_counts": f"{P1_RANKED} SELECT scene, count(*) AS clips, count(*) FILTER (WHERE scene IS NULL OR n <= {CAP}) AS kept_clips FROM ranked GROUP BY scene",
        "p2_densities": f"{P2_DRAWN} SELECT clip_id, family, direction, angle, cycles, round(density, 6) AS density, round(draw_key, 6) AS draw_key, drawn FROM drawn",
        "p2_varied_subset": f"{P2_DRAWN} SELECT clip_id, family, direction, angle, cycles, round(density, 6) AS density, round(draw_key, 6) AS draw_key FROM drawn WHERE drawn",
        "p2_setting_report": f"""{P2_DRAWN}, each AS (SELECT family, direction, angle, cycles, count(*) AS clips, count(*) FILTER (WHERE drawn) AS drawn FROM drawn GROUP BY ALL)
            SELECT CAST(floor(log10(clips) + 1e-9) AS INT) AS tens, count(*) AS settings, CAST(sum(clips) AS BIGINT) AS clips, CAST(sum(drawn) AS BIGINT) AS drawn, count(*) FILTER (WHERE drawn > 0) AS settings_drawn,
                round(sum(clips) * (SELECT sum(drawn) / sum(clips) FROM each), 6) AS plain_sample FROM each GROUP BY 1""",
        "p3_found": f"""
            WITH RECURSIVE {HUBS}, pairs AS (
                SELECT DISTINCT a.group_id AS g, b.group_id AS h FROM (SELECT hub, min(group_id) AS group_id FROM links WHERE hub IS NOT NULL GROUP BY hub) a JOIN links b USING (hub)
            ), near AS (
                SELECT g, h FROM pairs UNION SELECT h, g FROM pairs
            ), reach AS (
                SELECT g, h FROM near UNION SELECT reach.g, near.h FROM reach JOIN near ON reach.h = near.g
            ), blocks AS (
                SELECT g AS group_id, min(h) AS block_first FROM reach GROUP BY g
            ), scenes AS (
                SELECT block_first FROM blocks JOIN consistency_groups USING (group_id) WHERE trim(scene_id) <> '' GROUP BY block_first HAVING count(DISTINCT {SCENE}) >= 2
            )
            SELECT block_first, group_id FROM blocks JOIN scenes USING (block_first)
        """,
        "p4_found": f"""
            SELECT axis, category FROM ({P4_AVAILABLE}) JOIN sample_targets USING (axis, category)
            WHERE available < greatest(min_count, target_share * (SELECT amount FROM plan_settings WHERE setting = 'sample_share') * (SELECT count(DISTINCT group_id) FROM candidate_groups))
        """,
        "p5_found": f"{P5_PAIRS} SELECT least(eval_id, train_id) AS clip_lo, greatest(eval_id, train_id) AS clip_hi FROM pairs",
        "p5_overlap_counts": f"{P5_PAIRS} SELECT split, engine, train_engine, count(*) AS pairs, count(DISTINCT eval_id) AS eval_clips FROM pairs GROUP BY ALL",
        "p5_similar_clips": f"""{P5_PAIRS.split("), pairs AS")[0]})
            SELECT e.split, count(*) AS pairs, count(*) FILTER (WHERE e.labels <> t.labels) AS near_pairs
            FROM now e JOIN now t ON e.split <> 'train' AND t.split = 'train' AND e.scene = t.scene AND e.question_type = t.question_type AND e.dim = t.dim AND e.labels <> '' AND t.labels <> ''
                AND round(abs(e.metres - t.metres), 9) < 0.15 AND len(list_intersect({MULTISET.format(x="e.labels")}, {MULTISET.format(x="t.labels")})) * 2
                    >= len(list_distinct(list_concat({MULTISET.format(x="e.labels")}, {MULTISET.format(x="t.labels")})))
            GROUP BY 1""",
        "p6_stable_sample": f"{P6_IDS} SELECT kind, ident, stratum FROM ids WHERE place < share",
        "p6_grown_sample": f"""{P6_IDS} SELECT kind, ident, stratum, early AND place < share AS first, true AS now FROM ids
            WHERE place < share * CASE WHEN stratum LIKE '%/object_pair_distance_center' THEN 2 ELSE 1 END""",
    }
