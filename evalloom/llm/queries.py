"""The queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.capping import cap_per_contributor
from evalloom.llm.common import blank_to_null, current_delivery, label_keys, local_rows, nearest_category, salted_join, scene_key, setting, squash, table
from evalloom.llm.language import fit_on_documents, label_language, language_stretches
from evalloom.llm.linked_splits import ComponentTable, reissue_base, shared_object_tags
from evalloom.llm import mixing
from evalloom.llm.mixing import mix, unique_texts
from evalloom.llm.overlap import overlap_pairs, parse_metres
from evalloom.llm.packing import pack_texts
from evalloom.llm.quota_sample import REPORT, quota_sample
from evalloom.llm.stable import load_thresholds, raise_thresholds, save_thresholds, stable_sample
from evalloom.llm.tokens import RANKS, measured
from evalloom.llm.variety import density_weighted, varied_subset
from evalloom.session import cut_lineage, scratch

PAIR_WITHIN = 0.15


# ---- 1: clips capped per scene ----


def clips_with_scene(spark: SparkSession, folder: str) -> DataFrame:
    """(clip_id, scene, quality_score): current deliveries, a blank scene taken from any row of the clip's group."""
    clips = table(spark, folder, "clips").select("clip_id", "group_id", scene_key(F.col("scene_id")).alias("scene"), "quality_score", "ingested_at")
    now = current_delivery(clips, "clip_id", "ingested_at", ["group_id", "scene", "quality_score"])
    groups = table(spark, folder, "consistency_groups").select("group_id", scene_key(F.col("scene_id")).alias("group_scene"))
    groups = groups.where(F.col("group_scene").isNotNull()).groupBy("group_id").agg(F.min("group_scene").alias("group_scene"))
    placed = now.where(F.col("scene").isNotNull()).select("clip_id", "group_id", "scene", "quality_score")
    lost = now.where(F.col("scene").isNull()).select("clip_id", "group_id", "quality_score").join(groups, "group_id", "left")
    return placed.unionByName(lost.select("clip_id", "group_id", F.col("group_scene").alias("scene"), "quality_score")).drop("group_id")


def _capped(spark: SparkSession, folder: str, best: bool) -> DataFrame:
    cap = int(setting(spark, folder, "max_clips_per_scene"))
    return cap_per_contributor(clips_with_scene(spark, folder), "clip_id", "scene", "quality_score", cap, best=best)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Clips ranked after the cap in their scene: a cold reservoir, whose close calls are settled by score."""
    return _capped(spark, folder, True).where(~F.col("kept")).select("clip_id")


def p1_capped_clips(spark: SparkSession, folder: str) -> DataFrame:
    """The clips that come out: no scene above the cap, the best of each kept. A quality of NaN is given as null."""
    return _capped(spark, folder, True).where("kept").select("clip_id", "scene", "quality_score")


def p1_reservoir_clips(spark: SparkSession, folder: str) -> DataFrame:
    """The same cap by a random reservoir weighted by quality (temperature 1)."""
    return _capped(spark, folder, False).where("kept").select("clip_id", "scene", "quality_score", F.round("reservoir_key", 6).alias("reservoir_key"))


def p1_scene_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Clips of each scene before and after the cap."""
    out = _capped(spark, folder, True).groupBy("scene").agg(F.count(F.lit(1)).alias("clips"), F.count_if("kept").alias("kept_clips"))
    return out.select("scene", "clips", "kept_clips")


# ---- 2: varied subset ----

FAMILIES = ["approach", "passby", "around", "spherical", "rotation"]
DIRECTIONS = ["cw", "ccw", "fw", "bw"]


def direction_key(direction, trajectory):
    """cw, ccw, fw or bw, from the direction or, where that says nothing, the end of the trajectory; else unknown."""

    def read(word):
        w = squash(word)
        return (
            F.when(w.rlike("(counterclockwise|anticlockwise|ccw)$"), "ccw").when(w.rlike("(clockwise|cw)$"), "cw").when(w.rlike("(forwards?|fw)$"), "fw").when(w.rlike("(backwards?|bw)$"), "bw")
        )

    return F.coalesce(read(direction), read(trajectory), F.lit("unknown"))


def motion_settings(spark: SparkSession, folder: str) -> DataFrame:
    """(clip_id, family, direction, angle, cycles): current deliveries with their motion setting written one way; angles to whole degrees in [0, 360).

    An unknown angle is -1, an unknown count of cycles -1: settings of their own.
    """
    clips = table(spark, folder, "clips")
    family = F.coalesce(F.nullif(F.regexp_extract(squash(F.col("trajectory")), "^(" + "|".join(FAMILIES) + ")", 1), F.lit("")), F.lit("other"))
    angle = F.pmod(F.round("start_angle_offset"), F.lit(360.0))
    slim = clips.select(
        "clip_id", "ingested_at", family.alias("family"), direction_key(F.col("direction"), F.col("trajectory")).alias("way"),
        F.when(angle.between(0.0, 360.0), angle.cast("int")).otherwise(-1).alias("angle"), F.greatest(F.coalesce("cycle_count", F.lit(-1)), F.lit(-1)).alias("cycles"),
    )
    now = current_delivery(slim, "clip_id", "ingested_at", ["family", "way", "angle", "cycles"])
    return now.withColumnRenamed("way", "direction")


def _motion_features():
    turn, known = F.radians(F.col("angle").cast("double")), (F.col("angle") >= 0).cast("double")
    hot = [(F.col("family") == x).cast("double") * 4.0 for x in FAMILIES] + [(F.col("direction") == x).cast("double") * 2.0 for x in DIRECTIONS]
    return [*hot, F.cos(turn) * 2.0 * known, F.sin(turn) * 2.0 * known, known * 4.0, F.col("cycles").cast("double")]


SETTING = ["family", "direction", "angle", "cycles"]


def _variety(spark: SparkSession, folder: str) -> dict:
    return {"ident": "clip_id", "setting": SETTING, "features": _motion_features(), "size": int(setting(spark, folder, "varied_subset_size"))}


def p2_densities(spark: SparkSession, folder: str) -> DataFrame:
    """Every clip with the density of its setting, its draw key and whether it is drawn into the subset of varied_subset_size clips."""
    out = density_weighted(motion_settings(spark, folder), **_variety(spark, folder))
    return out.withColumns({"density": F.round("density", 6), "draw_key": F.round("draw_key", 6)})


def p2_varied_subset(spark: SparkSession, folder: str) -> DataFrame:
    """varied_subset_size clips, drawn with probability inverse to the density of their motion setting."""
    out = varied_subset(motion_settings(spark, folder), **_variety(spark, folder))
    return out.withColumns({"density": F.round("density", 6), "draw_key": F.round("draw_key", 6)})


def p2_setting_report(spark: SparkSession, folder: str) -> DataFrame:
    """Settings by how many clips share them (powers of ten): settings, clips, drawn clips, settings with a drawn clip, and the clips that a plain sample of that size would have."""
    keyed = density_weighted(motion_settings(spark, folder), **_variety(spark, folder))
    each = keyed.groupBy(*SETTING).agg(F.count(F.lit(1)).alias("clips"), F.count_if("drawn").alias("drawn"))
    out = each.groupBy(F.floor(F.log10("clips") + 1e-9).cast("int").alias("tens")).agg(F.count(F.lit(1)).alias("settings"), F.sum("clips").alias("clips"), F.sum("drawn").alias("drawn"), F.count_if(F.col("drawn") > 0).alias("settings_drawn"))
    whole = out.agg(F.sum("drawn") / F.sum("clips")).scalar()
    return out.withColumn("plain_sample", F.round(F.col("clips") * whole, 6))


# ---- 3: splits that keep related groups together ----


def group_links(groups: DataFrame) -> DataFrame:
    """(record, hub) of consistency groups: the scene, every tagged object, and the group that a re-issued one was made from."""
    hubs = F.array_append(
        F.array_prepend(F.transform(shared_object_tags(F.coalesce("anchor_ids", F.array().cast("array<string>"))), lambda x: F.concat(F.lit("2 object "), x)), F.concat(F.lit("1 scene "), scene_key(F.col("scene_id")))),
        F.concat(F.lit("3 issue "), reissue_base(F.col("group_id"))),
    )
    return groups.select(F.col("group_id").alias("record"), F.explode(hubs).alias("hub")).where(F.col("hub").isNotNull())


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every group of a block that holds two or more scenes, from the component table."""
    groups = table(spark, folder, "consistency_groups").select("group_id", "scene_id", "anchor_ids")
    known = ComponentTable(spark, scratch(spark, "components"))
    known.extend(group_links(groups))
    scenes = groups.select(F.col("group_id").alias("record"), scene_key(F.col("scene_id")).alias("scene")).groupBy("record").agg(F.min("scene").alias("lo"), F.max("scene").alias("hi"))
    blocks = cut_lineage(known.blocks().join(scenes, "record"))
    mixed = blocks.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("lo") != F.col("hi")).select("block")
    return salted_join(blocks, mixed, "block", F.col("record")).select(F.col("block").alias("block_first"), F.col("record").alias("group_id"))


def _split_targets(spark: SparkSession, folder: str) -> dict[str, float]:
    return {r["split"]: r["target_share"] for r in table(spark, folder, "split_targets").collect()}


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every group with its block and split, of one run over all deliveries."""
    known = ComponentTable(spark, scratch(spark, "components"))
    known.extend(group_links(table(spark, folder, "consistency_groups")), _split_targets(spark, folder))
    return known.splits().select(F.col("record").alias("group_id"), F.col("block").alias("block_first"), "split", "status")


def p3_incremental_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The same in three runs over thirds of the time that the deliveries cover, each extending the component table that the ones before left."""
    groups = table(spark, folder, "consistency_groups").select("group_id", "scene_id", "anchor_ids", "ingested_at")
    seconds = F.col("ingested_at").cast("timestamp").cast("double")
    lo, hi = groups.agg(F.min(seconds), F.max(seconds)).head()
    third = F.coalesce(F.least(F.floor((seconds - F.lit(lo or 0.0)) / F.lit(max(1.0, ((hi or 0.0) - (lo or 0.0)) / 3))), F.lit(2)), F.lit(2))
    known = ComponentTable(spark, scratch(spark, "components"))
    for i in range(3):
        known.extend(group_links(groups.where(third == i)), _split_targets(spark, folder))
    return known.splits().select(F.col("record").alias("group_id"), F.col("block").alias("block_first"), "split", "status")


def p3_split_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of the groups in each split, and the largest block in it."""
    rows = p3_splits(spark, folder)
    sizes = rows.groupBy("split", "block_first").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.sum("n").alias("groups"), F.max("n").alias("largest_block"))
    targets = table(spark, folder, "split_targets").join(sizes, "split", "left").select("split", "target_share", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("largest_block", F.lit(0)).alias("largest_block"))
    return targets.withColumn("actual_share", F.round(F.try_divide(F.col("groups"), targets.agg(F.sum("groups")).scalar()), 6))


# ---- 4: sample that meets target proportions ----

AXES = ["question_family", "room_bucket", "motion_family"]
FAMILY_OF_TYPE = {"object_dimensions": "size", "object_distance_to_camera": "camera_distance", "object_pair_distance_center": "pair_distance"}


def categorised_groups(spark: SparkSession, folder: str, categories: dict[str, list[str]]) -> DataFrame:
    """(group_id, question_family, room_bucket, motion_family) of the distinct groups in candidate_groups; null where a category is unknown."""
    groups = table(spark, folder, "consistency_groups")
    by_type = F.lit(None).cast("string")
    for kind, family in FAMILY_OF_TYPE.items():
        by_type = F.when(F.trim("question_type") == kind, family).otherwise(by_type)
    known = groups.select(
        "group_id", by_type.alias("typed"), nearest_category(F.col("room_bucket"), categories["room_bucket"]).alias("room"), nearest_category(F.col("motion_family"), categories["motion_family"]).alias("motion")
    )
    known = known.groupBy("group_id").agg(F.min("typed").alias("typed"), F.min("room").alias("room_bucket"), F.min("motion").alias("motion_family"))
    wanted = table(spark, folder, "candidate_groups").where(F.col("group_id").isNotNull())
    wanted = wanted.select("group_id", nearest_category(F.col("question_family"), categories["question_family"]).alias("family")).groupBy("group_id").agg(F.min("family").alias("family"))
    return wanted.join(known, "group_id", "left").select("group_id", F.coalesce("family", "typed").alias("question_family"), "room_bucket", "motion_family")


def _quota(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple]]:
    rows = table(spark, folder, "sample_targets").collect()
    categories = {a: [r["category"] for r in rows if r["axis"] == a] for a in AXES}
    groups = cut_lineage(categorised_groups(spark, folder, categories))
    targets = {(r["axis"], r["category"]): (r["target_share"], r["min_count"]) for r in rows}
    return quota_sample(groups, "group_id", AXES, targets, groups.count() * setting(spark, folder, "sample_share"))


def p4_target_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sampled groups with their categories."""
    return _quota(spark, folder)[0]


def p4_target_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every target with what is available, needed and sampled, whether it is missed and why."""
    return local_rows(spark, _quota(spark, folder)[1], REPORT)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that the repaired sample misses, and, checked after that, that no sample can meet as there are too few groups."""
    missed = p4_target_report(spark, folder).where("unmet")
    return missed.where(F.col("available") < F.col("needed")).select("axis", "category")


# ---- 5: overlaps across splits ----


def split_records(spark: SparkSession, folder: str) -> DataFrame:
    clips = table(spark, folder, "clips").select(
        "clip_id", "ingested_at", "split", "engine", (F.col("split") != "train").alias("is_eval"),
        F.when(F.col("scene_id").isNotNull(), F.concat_ws("|", scene_key(F.col("scene_id")), F.coalesce("question_type", F.lit("")), F.coalesce(blank_to_null(F.col("dimension")), F.lit("")))).alias("place_all"),
        scene_key(F.col("scene_id")).isNotNull().alias("placed"), label_keys(F.col("anchor_labels")).alias("labels"), parse_metres(F.col("ground_truth")).alias("metres"),
    )
    clips = clips.withColumn("place", F.when(F.col("placed"), F.col("place_all"))).drop("placed", "place_all")
    return current_delivery(clips, "clip_id", "ingested_at", ["split", "engine", "is_eval", "place", "labels", "metres"])


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_pairs(split_records(spark, folder), "clip_id", "is_eval", F.col("place"), "labels", "metres", PAIR_WITHIN, ["split", "engine"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _overlaps(spark, folder)
    return pairs.select(F.least("eval_id", "train_id").alias("clip_lo"), F.greatest("eval_id", "train_id").alias("clip_hi"))


def p5_overlap_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs, and the distinct evaluation clips in them, by evaluation split and the engines of both sides."""
    pairs = _overlaps(spark, folder).groupBy("eval_split", "eval_engine", "train_engine", "eval_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(F.col("eval_split").alias("split"), F.col("eval_engine").alias("engine"), "train_engine").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("eval_clips"))


def p5_similar_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs across splits that share half of their labels or more, by evaluation split: the overlaps that equality does not find are among them."""
    records = split_records(spark, folder)
    pairs = overlap_pairs(records, "clip_id", "is_eval", F.col("place"), "labels", "metres", PAIR_WITHIN, ["split", "labels"], share=0.5)
    same = F.col("eval_labels") == F.col("train_labels")
    return pairs.groupBy(F.col("eval_split").alias("split")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~same).alias("near_pairs"))


# ---- 6: stable sample ----


ENGINES = ["thor", "interiorgs"]
SCARCE_TYPE = "object_pair_distance_center"


def _strata(share: float, scarce: float) -> dict[str, float]:
    """The fixed rate of each stratum, engine and question type; any other has ``share``, under the key ""."""
    return {"": share, **{f"{e}/{t}": scarce if t == SCARCE_TYPE else share for e in ENGINES for t in FAMILY_OF_TYPE}}


def _stable(spark: SparkSession, folder: str, thresholds: dict[str, float], keep=lambda df: df) -> DataFrame:
    stratum = F.concat_ws("/", "engine", "question_type")
    parts = [stable_sample(keep(table(spark, folder, name)), f"{kind}_id", stratum, thresholds, salt=kind).withColumn("kind", F.lit(kind)) for kind, name in (("clip", "clips"), ("group", "consistency_groups"))]
    return parts[0].unionByName(parts[1]).select("kind", "ident", "stratum")


def p6_stable_sample(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, ident, stratum): stable_sample_share of the clip ids and of the group ids, the same rate in each stratum of engine and question type."""
    share = setting(spark, folder, "stable_sample_share")
    return _stable(spark, folder, raise_thresholds(_strata(share, share)))


def p6_grown_sample(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, ident, stratum, first, now): the sample of the batches up to the middle one, and that of all batches after the rate of the
    scarce question type was doubled against the stored thresholds and that of the others was asked to fall, which it may not. now is true for every row."""
    share = setting(spark, folder, "stable_sample_share")
    clips = table(spark, folder, "clips")
    middle = clips.agg(((F.min("batch_no") + F.max("batch_no")) / 2).alias("m")).head()[0] or 0.0
    early = clips.where(F.col("batch_no") <= middle)
    kept = scratch(spark, "thresholds")
    save_thresholds(spark, raise_thresholds(_strata(share, share)), f"{kept}/1")
    first = _stable(spark, folder, load_thresholds(spark, f"{kept}/1"), lambda df: df.where(F.col("batch_no") <= middle) if "batch_no" in df.columns else df.join(early.select("group_id").distinct(), "group_id", "left_semi"))
    save_thresholds(spark, raise_thresholds(_strata(share / 2, min(1.0, 2 * share)), load_thresholds(spark, f"{kept}/1")), f"{kept}/2")
    now = _stable(spark, folder, load_thresholds(spark, f"{kept}/2"))
    both = first.withColumns({"first": F.lit(True), "now": F.lit(False)}).unionByName(now.withColumns({"first": F.lit(False), "now": F.lit(True)}))
    return both.groupBy("kind", "ident").agg(F.min("stratum").alias("stratum"), F.max("first").alias("first"), F.max("now").alias("now"))


# ---- 7: containers of tokens ----


#: Limits of a container besides its tokens: texts, and the share of the capacity that may bear loss (text after a first sentence does).
MOST_SEGMENTS = 24
LOSS_SHARE = 0.96


def p7_containers(spark: SparkSession, folder: str, tokenizer: str = RANKS) -> DataFrame:
    """Every text, or piece of a text larger than a container, with its container."""
    docs = measured(table(spark, folder, "documents"), "text", ["doc_id"], tokenizer)
    capacity = int(setting(spark, folder, "pack_capacity_tokens"))
    return pack_texts(docs, "doc_id", "tokens", "prompt_tokens", capacity, MOST_SEGMENTS, int(LOSS_SHARE * capacity))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how full they are, in tenths of the capacity: how many, the pieces and tokens in them, the share of their room that is used, and how many reach
    each of the limits (tokens, segments, loss-bearing tokens) to within a hundredth, or go past the last as a text alone."""
    capacity = setting(spark, folder, "pack_capacity_tokens")
    each = p7_containers(spark, folder).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss"), F.count(F.lit(1)).alias("pieces"))
    tenth = F.least(F.floor(F.col("tokens") * 10 / F.lit(capacity)), F.lit(9)).cast("int")
    out = each.groupBy(tenth.alias("filled_tenths")).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") >= 0.99 * capacity).alias("at_tokens"),
        F.count_if(F.col("pieces") >= MOST_SEGMENTS).alias("at_segments"), F.count_if(F.col("loss") >= 0.99 * LOSS_SHARE * capacity).alias("at_loss"),
    )
    return out.withColumn("used_share", F.col("tokens") / (F.col("containers") * F.lit(capacity)))


# ---- 8: sources mixed to target weights ----


def _mixed(spark: SparkSession, folder: str, tokenizer: str = RANKS) -> tuple[DataFrame, list[tuple]]:
    rows = table(spark, folder, "source_weights").collect()
    names = F.lit(None).cast("string")
    for r in rows:
        names = F.when(squash(F.col("source")) == "".join(ch for ch in r["source"].lower() if ch.isalnum()), r["source"]).otherwise(names)
    docs = table(spark, folder, "documents").select("doc_id", names.alias("source"), "text").where(F.col("source").isNotNull())
    sized = measured(docs, "text", ["doc_id", "source"], tokenizer)
    # Quality: prose rather than tables, identifiers and numbers, and not a scrap of a few tokens.
    sized = sized.withColumn("quality", F.least(F.lit(1.0), F.col("tokens") / 60.0) * F.col("letters"))
    texts = unique_texts(sized, "doc_id", "source", "fingerprint", "tokens", "quality")
    return mix(texts, {r["source"]: (r["target_share"], r["max_repeats"]) for r in rows})


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the mix and how often each is used."""
    return _mixed(spark, folder)[0].withColumnRenamed("ident", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Every source with its target and actual share of the tokens."""
    return local_rows(spark, _mixed(spark, folder)[1], mixing.REPORT)


# ---- 9: languages of documents ----


def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label, stretches): label is the code that the lang column names, null if it names none."""
    docs = table(spark, folder, "documents").select("doc_id", label_language(F.col("lang")).alias("label"), F.trim("lang").alias("lang"), "text")
    model = fit_on_documents(table(spark, folder, "lang_samples"), "sample_text", "lang", docs, "doc_id", "text", F.col("label"))
    return language_stretches(docs, "doc_id", "text", model, ["label"])


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of every document whose label is missing or wrong or that holds several languages."""
    found = document_languages(spark, folder)
    wrong = F.col("label").isNull() | (F.col("label") != F.col("stretches")[0]["lang"])
    wanted = found.where((F.size("stretches") > 1) | ((F.size("stretches") == 1) & wrong))
    return wanted.select("doc_id", F.posexplode("stretches").alias("pos", "s")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("seg_no"), F.col("s.lang").alias("lang"))


def p9_document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the language of most of its words, the share of it and its confidence; null for wordless texts."""
    found = document_languages(spark, folder)
    total = F.aggregate("stretches", F.lit(0.0), lambda a, s: a + s["words"])
    most = F.array_max(F.transform(F.array_distinct(F.transform("stretches", lambda s: s["lang"])), lambda x: F.struct(F.aggregate(F.filter("stretches", lambda s: s["lang"] == x), F.lit(0.0), lambda a, s: a + s["words"]).alias("words"), x.alias("lang"))))
    mean = F.aggregate(F.filter("stretches", lambda s: s["lang"] == F.col("top.lang")), F.lit(0.0), lambda a, s: a + s["words"] * s["confidence"]) / F.col("top.words")
    out = found.withColumn("top", most)
    return out.select("doc_id", F.col("label").alias("given_lang"), F.col("top.lang").alias("lang"), (F.col("top.words") / total).alias("share"), mean.alias("confidence"), F.size("stretches").alias("stretches"))


def p9_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of every document with its place, language and confidence."""
    found = document_languages(spark, folder).select("doc_id", F.posexplode("stretches").alias("pos", "s"))
    return found.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("seg_no"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"))


def llm_queries() -> dict:
    """In order of the problems; the first of each is the one with the whole result."""
    listed = [
        p1_found, p1_capped_clips, p1_reservoir_clips, p1_scene_counts, p2_densities, p2_varied_subset, p2_setting_report, p3_found, p3_splits, p3_incremental_splits, p3_split_shares,
        p4_found, p4_target_sample, p4_target_report, p5_found, p5_overlap_counts, p5_similar_clips, p6_stable_sample, p6_grown_sample, p7_containers, p7_fill, p8_mix, p8_shares,
        p9_found, p9_document_labels, p9_stretches,
    ]
    return {f.__name__: f for f in listed}
