"""Questions from scene objects: which objects and pairs qualify, what is asked about them, and what the answer is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.geometry import distance
from evalloom.operators.joins import band_pairs

#: Items of a view that meet in one piece; a larger view is cut into blocks of about as many.
BLOCK = 64


def usable_objects(df: DataFrame, scene: str, kind: str, size: Column, least: float, most: float, skip: list[str], visible: Column | None = None) -> DataFrame:
    """Objects of no skipped kind, with a size within bounds and visible, that are then the only one of their kind in the scene."""
    kept = df.where(~F.lower(F.col(kind)).isin(*[s.lower() for s in skip]) & size.between(least, most))
    kept = kept if visible is None else kept.where(visible)
    alone = F.count(F.lit(1)).over(Window.partitionBy(scene, kind)) == 1
    return kept.withColumn("_alone", alone).where("_alone").drop("_alone")


def size_question(label: Column, dimension: Column) -> Column:
    return F.concat(F.lit("What is the "), dimension, F.lit(" of the "), label, F.lit(" in metres?"))


def camera_question(label: Column) -> Column:
    return F.concat(F.lit("How far is the "), label, F.lit(" from the camera, in metres?"))


def distance_question(a: Column, b: Column) -> Column:
    return F.concat(F.lit("How far apart are the "), a, F.lit(" and the "), b, F.lit(", in metres?"))


def comparison_question(a: Column, b: Column, measure: str) -> Column:
    return F.concat(F.lit("Which has the larger "), F.lit(measure), F.lit(", A: the "), a, F.lit(", or B: the "), b, F.lit("?"))


def size_questions(df: DataFrame, keys: list[str], label: str, dims: list[str], digits: int = 1) -> DataFrame:
    """(keys, dimension, question, answer): one row an object and dimension; a null size gives none. Ties of rounding go up."""
    rows = df.select(*keys, label, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("value")) for d in dims])).alias("_d")).where(F.col("_d.value").isNotNull())
    return rows.select(*keys, F.col("_d.dimension").alias("dimension"), size_question(F.col(label), F.col("_d.dimension")).alias("question"), F.round(F.col("_d.value") + F.lit(1e-9), digits).alias("answer"))


def pair_questions(df: DataFrame, scene: str, ident: str, value: str, least: float, most: float) -> DataFrame:
    """(scene, id_a, id_b, question, answer) for pairs of one scene whose values differ by ``least`` to ``most``; pairs further apart are never formed."""
    pairs = band_pairs(df, scene, ident, value, most, F.abs(F.col("value_a") - F.col("value_b")) >= least)
    a, b = F.col("id_a").cast("string"), F.col("id_b").cast("string")
    return pairs.select(scene, "id_a", "id_b", distance_question(a, b).alias("question"), F.round(F.abs(F.col("value_a") - F.col("value_b")) + F.lit(1e-9), 1).alias("answer"))


def first_pairs(df: DataFrame, scene: str, ident: str, columns: list[str], most: int) -> DataFrame:
    """(scene, pair, <column>_a, <column>_b for the ident and each column): the first ``most`` pairs of objects of each scene, in the order of the first and then the second ident; pair counts from 0.

    Only a scene's first ``most`` + 1 objects can be in them; they are what is shuffled and gathered.
    """
    at = F.row_number().over(Window.partitionBy(scene).orderBy(ident))
    first = df.withColumn("_at", at).where(F.col("_at") <= most + 1)
    objects = F.array_sort(F.collect_list(F.struct(ident, *columns))).alias("_o")
    held = first.groupBy(scene).agg(objects)
    pairs = F.flatten(F.transform("_o", lambda a, i: F.transform(F.slice(F.col("_o"), i + 2, most), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = held.select(scene, F.posexplode(F.slice(pairs, 1, most)).alias("pair", "_p"))
    return each.select(scene, "pair", *[F.col(f"_p.{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in (ident, *columns)])


def _rounded(x: Column, digits: int = 1) -> Column:
    return F.round(x + F.lit(1e-9), digits)


def _rows(pairs: DataFrame, keys: list[str], rows: list[Column]) -> DataFrame:
    """One row a struct of ``rows`` that is not null."""
    out = pairs.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("_q"))
    return out.select(*keys, "_q.*")


def _question(kind: str, question: Column, answer: Column, needed: Column, extra: Column) -> Column:
    made = F.struct(F.lit(kind).alias("question_type"), extra.alias("dimension"), question.alias("question"), answer.alias("answer"))
    return F.when(F.coalesce(needed, F.lit(False)) & answer.isNotNull(), made)


def size_comparisons(pairs: DataFrame, keys: list[str], name: str, dims: list[str]) -> DataFrame:
    """(keys, question_type, dimension, question, answer) for pairs with <name>_a, <name>_b and <dim>_a, <dim>_b: how many times as large the first is in each dimension, and how large it
    is given the other's size. A null size, or one of 0 of the second, gives none."""
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    rows = []
    for d in dims:
        x, y = F.col(f"{d}_a").cast("double"), F.col(f"{d}_b").cast("double")
        there = y != 0
        rows.append(_question("object_size_comparison_relative", F.concat(F.lit(f"How many times the {d} of the "), b, F.lit(f" is the {d} of the "), a, F.lit("?")), _rounded(F.try_divide(x, y)), there, F.lit(d)))
        given = F.concat(F.lit(f"If the {d} of the "), b, F.lit(" is "), F.format_string("%.1f", _rounded(y)), F.lit(f" metres, what is the {d} of the "), a, F.lit(" in metres?"))
        rows.append(_question("object_size_comparison_absolute", given, _rounded(x), there, F.lit(d)))
    return _rows(pairs, keys, rows)


def distance_rows(pairs: DataFrame, keys: list[str], name: str, place: str, dims: list[str]) -> DataFrame:
    """(keys, question_type, dimension, question, answer) for pairs with places (arrays of three): the distance of the centres, and the same given each size of the first that is not 0."""
    a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
    gap = _rounded(distance(F.col(f"{place}_a"), F.col(f"{place}_b")))
    rows = [_question("object_pair_distance_center", distance_question(a, b), gap, F.lit(True), F.lit(None).cast("string"))]
    for d in dims:
        x = F.col(f"{d}_a").cast("double")
        given = F.concat(F.lit("The "), a, F.lit(" has a "), F.lit(d), F.lit(" of "), F.format_string("%.1f", _rounded(x)), F.lit(" metres. "), distance_question(a, b))
        rows.append(_question("object_pair_distance_center_w_size", given, gap, x != 0, F.lit(d)))
    return _rows(pairs, keys, rows)


def distance_comparisons(quads: DataFrame, keys: list[str], names: list[str], first: Column, second: Column) -> DataFrame:
    """(keys, question_type, dimension, question, answer): how many times the distance of the pair ``names[2:]``, which is ``second``, the distance of ``names[:2]`` is, which is ``first``; and
    what it is, given the other. No ratio for a second distance of 0."""
    a, b, x, y = [F.col(n) for n in names]
    pair = lambda p, q: F.concat(F.lit("the "), p, F.lit(" and the "), q)
    ratio = F.concat(F.lit("How many times as far apart as "), pair(x, y), F.lit(" are "), pair(a, b), F.lit("?"))
    given = F.concat(F.lit("If "), pair(x, y), F.lit(" are "), F.format_string("%.1f", _rounded(second)), F.lit(" metres apart, how far apart are "), pair(a, b), F.lit(", in metres?"))
    none = F.lit(None).cast("string")
    return _rows(quads, keys, [
        _question("object_distance_comparison_relative", ratio, _rounded(F.try_divide(first, second)), second != 0, none), _question("object_comparison_absolute_distance", given, _rounded(first), second.isNotNull(), none)
    ])


def frequent_pairs(df: DataFrame, view: str, item: str, least: int, most_items: int | None = None) -> DataFrame:
    """(item_a, item_b, views) of items that occur together in at least ``least`` views.

    Only items in that many views can qualify, so others are dropped before pairs are formed. A view lists what one frame shows; one with
    more than BLOCK such items is cut into blocks by hash, and each two of its blocks meet under a key of their own, so a view of n items
    gives n(n-1)/2 pairs in many small tasks. ``most_items``: a view with more such items raises.
    """
    seen = df.select(view, item).where(F.col(view).isNotNull() & F.col(item).isNotNull()).distinct()
    common = seen.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(item)
    kept = seen.join(common, item)
    sizes = kept.groupBy(view).agg(F.count(F.lit(1)).alias("_n"))
    if most_items is not None:
        sizes = sizes.withColumn("_n", F.when(F.col("_n") > most_items, F.raise_error(F.lit("a view shows too many items")).cast("bigint")).otherwise(F.col("_n")))
    large = sizes.where(F.col("_n") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("_n") / BLOCK), F.lit(1))
    placed = kept.join(large, view, "left").select(view, item, blocks.alias("_blocks"), F.pmod(F.xxhash64(item), blocks).alias("_at"))
    a = placed.select(view, F.col(item).alias("_a"), F.col("_at").alias("_i"), F.explode(F.sequence("_at", F.col("_blocks") - 1)).alias("_j"))
    b = placed.select(view, F.col(item).alias("_b"), F.col("_at").alias("_j"), F.explode(F.sequence(F.lit(0).cast("bigint"), "_at")).alias("_i"))
    pairs = a.join(b, [view, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_b")))
    ordered = pairs.select(F.least("_a", "_b").alias("item_a"), F.greatest("_a", "_b").alias("item_b"))
    return ordered.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("views")).where(F.col("views") >= least)


def paired_entries(videos: DataFrame, questions: DataFrame, scene: str, applies: Column) -> DataFrame:
    """Videos with the questions of their scene that apply to them (a condition over the columns of both, aliased v and q)."""
    v, q = videos.alias("v"), questions.alias("q")
    return v.join(q, (F.col(f"v.{scene}") == F.col(f"q.{scene}")) & applies)
