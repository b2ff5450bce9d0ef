"""Tags, identifiers, prompts and questions as text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed motion words.
MOTIONS = ["approach", "passby", "around", "spherical", "rotation", "linear"]


def variation_parts(tag: Column) -> Column:
    """Struct cycles, kind, degrees of a tag such as '2x_start90'; nulls where it has another form."""
    p = r"^([0-9]+)x_(start|angle)([0-9]+)$"
    got = lambda i: F.nullif(F.regexp_extract(tag, p, i), F.lit(""))
    return F.struct(got(1).cast("int").alias("cycles"), got(2).alias("kind"), got(3).cast("int").alias("degrees"))


def motion_of(text: Column) -> Column:
    """The first motion word a trajectory name starts with; 'other' if none."""
    out = F.lit("other")
    for m in reversed(MOTIONS):
        out = F.when(F.startswith(F.lower(text), F.lit(m)), m).otherwise(out)
    return out


def direction_of(trajectory: Column) -> Column:
    return F.substring_index(trajectory, "_", -1)


def trajectory_base(trajectory: Column) -> Column:
    """Without its last '_part'."""
    return F.regexp_replace(trajectory, r"_[^_]*$", "")


def room_of_number(n: Column) -> Column:
    """Room kind by scene number: four hundreds of thirty."""
    return F.when(n.between(1, 30), "kitchen").when(n.between(201, 230), "living_room").when(n.between(301, 330), "bedroom").when(n.between(401, 430), "bathroom").otherwise("other")


def scene_number(scene: Column) -> Column:
    """The number at the end of a scene name; null if there is none."""
    return F.nullif(F.regexp_extract(scene, r"([0-9]+)$", 1), F.lit("")).cast("int")


def engine_of(given: Column, scene: Column) -> Column:
    """The engine given, else told from the form of the scene name."""
    return F.coalesce(F.nullif(F.lower(F.trim(given)), F.lit("")), F.when(scene.rlike("(?i)floor ?plan"), "thor").when(scene.rlike("^[0-9]{4}_[0-9]+$"), "interiorgs"))


def compose_prompt(question: Column, before: str = "", after: str = "") -> Column:
    """Question between optional texts, parts joined by one blank; empty parts leave none."""
    parts = [F.lit(before.strip() or None), F.nullif(F.trim(question), F.lit("")), F.lit(after.strip() or None)]
    return F.concat_ws(" ", *[p.cast("string") for p in parts])


def for_image(question: Column, exact: bool = False) -> Column:
    """A question about a video asked about an image: case-sensitive replacement, or any case at word borders."""
    if exact:
        return F.replace(question, F.lit("in this video"), F.lit("in this image"))
    return F.regexp_replace(question, r"(?i)\bin (?:this|the) (?:video|clip)\b", "in this image")


def before_marker(text: Column, marker: str = "[Output]") -> Column:
    return F.rtrim(F.split_part(text, F.lit(marker), F.lit(1)))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, blanks at the cut removed, with '…' where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def key_values(text: Column) -> Column:
    """'a=1,b=2' as a map of strings."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def stable_id(*parts: Column, seed: str = "") -> Column:
    """48 bits of SHA-256 over the parts: the same on every run and in every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *parts), 256), 1, 12), 16, 10).cast("long")


def asked(conversations: Column) -> Column:
    """The first human turn of a conversation without media tags."""
    said = F.get(F.filter(conversations, lambda c: c["from"] == "human"), F.lit(0))["value"]
    return F.trim(F.regexp_replace(said, "<(?:image|video)>", ""), F.lit(" \n\t"))


def question_kind(question: Column) -> Column:
    """pair_distance, camera_distance, size or unknown, by words. 'distance between' alone decides; 'distance from' only without a camera. The words and their order are fixed values."""
    q = F.lower(question)
    has = lambda w: F.contains(q, F.lit(w))
    pair = has("distance between") | (has("distance from") & ~has("camera"))
    return F.when(pair, "pair_distance").when(has("distance") & has("camera"), "camera_distance").when(has("width") | has("height") | has("length"), "size").otherwise("unknown")


def scene_edit(edit: Column) -> Column:
    """Variation of an edited scene; a turned object is not a turning camera. Null for other edits."""
    return F.when(edit == "rotate", "obj_rotation").when(edit.isin("translate", "remove"), edit)


def camera_variation(motion: Column) -> Column:
    return F.when(motion == "rotation", "cam_rotation").otherwise(motion)


def motion_in_group_id(group_id: Column) -> Column:
    """The motion word between the engine and the question type of a group id; null if it has another form. Fixed pattern."""
    return F.nullif(F.regexp_extract(group_id, r"^[a-z]+_(\w+?)_object_(?:pair_distance_center|distance_to_camera|dimensions)(?:_|$)", 1), F.lit(""))


def frame_number(name: Column) -> Column:
    """12 for 'frame_00012.png'; null for other names."""
    return F.nullif(F.regexp_extract(name, r"(?:^|/)frame_([0-9]+)(?:\.[^/]*)?$", 1), F.lit("")).cast("int")


def after_last_slash(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def primary_label(object_id: Column) -> Column:
    return F.nullif(F.substring_index(object_id, "|", 1), F.lit(""))


def pair_in_question_id(question_id: Column) -> Column:
    """Struct a, b: the two labels in a pair question's id, each followed by three coordinates. Fixed pattern."""
    p = r"^object_pair_distance_center_(\w+?)\|[+-]?\d+\.\d+\|[+-]?\d+\.\d+\|[+-]?\d+\.\d+_(\w+?)\|[+-]?\d+\.\d+\|[+-]?\d+\.\d+\|[+-]?\d+\.\d+$"
    return F.struct(F.nullif(F.regexp_extract(question_id, p, 1), F.lit("")).alias("a"), F.nullif(F.regexp_extract(question_id, p, 2), F.lit("")).alias("b"))


def cycles_in_tag(tag: Column) -> Column:
    """The number before an 'x' that stands as a part of its own: 2 for 'start90_2x'."""
    return F.nullif(F.regexp_extract(tag, r"(?:^|_)([0-9]+)x(?:_|$)", 1), F.lit("")).cast("int")
