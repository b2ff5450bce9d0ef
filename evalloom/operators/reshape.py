"""Reshaping records: flatten and nest question lists, split vectors, route and normalise rows, build keys and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(df: DataFrame, base: list[str], nested: str, outer: bool = False) -> DataFrame:
    """One row an element of the array of structs ``nested``, after the base columns. A null or empty array gives no row, or one of nulls if ``outer``."""
    return df.select(*base, F.inline_outer(nested) if outer else F.inline(nested))


def nest(df: DataFrame, keys: list[str], order: str, columns: list[str], name: str) -> DataFrame:
    """(keys, name): the rows of each key as an array of structs in order. For keys whose rows fit a record, such as the questions of a clip."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))


def split_vector(df: DataFrame, vector: Column, names: list[str], ident: str, value: str = "value", dimension: str = "dimension") -> DataFrame:
    """One row a component of ``vector``, with its name and an id suffixed by '__dim_<name>'. Components beyond the names are left out."""
    slim = df.withColumn("_v", F.slice(vector, 1, len(names)))
    out = slim.select(*df.columns, F.posexplode("_v").alias("_i", value))
    named = out.withColumn(dimension, F.array(*[F.lit(n) for n in names])[F.col("_i")])
    return named.withColumn(ident, F.concat(F.col(ident).cast("string"), F.lit("__dim_"), F.col(dimension))).drop("_i", "_v")


def route(column: Column, branches: dict[str, Column], default: Column | None = None) -> Column:
    """A value by the type in ``column``; an unknown type raises unless a default is given."""
    out = default if default is not None else F.raise_error(F.concat(F.lit("no branch for "), F.coalesce(column, F.lit("null"))))
    for key, value in reversed(list(branches.items())):
        out = F.when(column == key, value).otherwise(out)
    return out


def normalise_union(parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Several record formats projected to one set of columns and united by name; a column that a format lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(*[c.alias(k) for k, c in columns.items()]) for df, columns in parts])


def remap_prefix(path: Column, old: str, new: str) -> Column:
    """``new`` in place of a leading ``old``; other paths are unchanged."""
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def replace_first(text: Column, old: str, new: str) -> Column:
    """Only the first occurrence replaced."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(new), F.substr(text, at + len(old)))).otherwise(text)


def path_part(path: Column, prefix: str) -> Column:
    """The first path component that starts with ``prefix``; null if none."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda p: F.startswith(p, F.lit(prefix))), F.lit(1))


def group_key(*parts: Column) -> Column:
    """Parts joined by '_', null parts left out."""
    return F.concat_ws("_", *parts)


def decimal_tag(x: Column) -> Column:
    """1.5 as '1p5'; null for null."""
    return F.when(x.isNotNull(), F.replace(F.format_string("%.1f", x.cast("double")), F.lit("."), F.lit("p")))


def label_key(labels: Column, most: int = 2, sep: str = "–") -> Column:
    """Labels without what follows '|', trimmed, empty ones left out, the first ``most`` sorted and joined."""
    clean = F.filter(F.transform(labels, lambda x: F.trim(F.substring_index(x, "|", 1))), lambda x: x != "")
    return F.concat_ws(sep, F.array_sort(F.slice(clean, 1, most)))


def atomic_labels(labels: Column) -> Column:
    """Distinct single labels of a list, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: F.trim(F.substring_index(x, "|", 1))), lambda x: x != "")))


def anchor_key(ids: Column) -> Column:
    return F.concat_ws("|", F.array_sort(ids))


def conversation(question: Column, answer: Column, marker: str = "<video>") -> Column:
    """A two-turn training conversation."""
    return F.array(
        F.struct(F.lit("human").alias("from"), F.concat(F.lit(f"{marker}\n"), question).alias("value")), F.struct(F.lit("gpt").alias("from"), answer.cast("string").alias("value"))
    )


def turn(conversations: Column, who: str) -> Column:
    """The first value of a speaker; null if there is none."""
    return F.get(F.filter(conversations, lambda c: c["from"] == who), F.lit(0))["value"]


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins."""
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def reconstruct_groups(df: DataFrame, group: str, order: Column, first: list[str], ident: str) -> DataFrame:
    """(group, first columns, n, members): the first row's columns of each group, and its ids in order. Members of a group must fit a record."""
    members = F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.col(ident).alias("_i"))))
    out = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(F.struct(*first), F.struct(order, F.col(ident))).alias("_f"), F.count(F.lit(1)).alias("n"), members.alias("_m"))
    return out.select(group, "_f.*", "n", F.transform("_m", lambda x: x["_i"]).alias("members"))


def assemble_groups(picked: DataFrame, group: str, clip: str, position: str, candidates: DataFrame, columns: list[str], target: int, least: int, folder: str) -> DataFrame:
    """(group, columns, clip_ids, clips, target_group_size, selected_group_size): records of the groups whose picked clips are at least ``least``.

    ``picked``: (group, clip, position from 1), see greedy.clips_of_group; ``candidates``: one row a group. Clips are numbered anew in the order picked: 'g_clip00' of group 'g' stands at
    position 1 and has its video under ``folder``; ``clips`` is an array of structs clip_id, source, video_path. A group's picks must fit a record.
    """
    held = F.array_sort(F.collect_list(F.struct(F.col(position).alias("_p"), F.col(clip).alias("_s"))))
    groups = picked.groupBy(group).agg(held.alias("_held")).where(F.size("_held") >= least)
    name = lambda i: F.concat(F.col(group), F.format_string("_clip%02d", i))
    clips = F.transform("_held", lambda x, i: F.struct(name(i).alias("clip_id"), x["_s"].alias("source"), F.concat(F.lit(f"{folder}/videos/"), name(i), F.lit("/video.mp4")).alias("video_path")))
    out = candidates.select(group, *columns).join(groups, group)
    return out.select(group, *columns, F.transform(clips, lambda c: c["clip_id"]).alias("clip_ids"), clips.alias("clips"), F.lit(target).alias("target_group_size"), F.size("_held").alias("selected_group_size"))
