"""Joins beyond the plain equi-join: null-safe reuse, bands, boxes, nearest points, dominance, last-wins lookups and ordered look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.session import cut_lineage

CELLS = 1024


def null_safe(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """All columns equal, null equal to null."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def reuse_ratio(wanted: DataFrame, there: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, wanted, reused, ratio): the share of each group's rows whose composite key is among ``there``, null matching null."""
    keys = there.select(*columns).distinct().withColumn("_hit", F.lit(1))
    joined = wanted.select(group, *columns).join(keys, null_safe(wanted, keys, columns), "left").select(wanted[group], "_hit")
    return joined.groupBy(group).agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("reused")).withColumn("ratio", F.col("reused") / F.col("wanted"))


def last_wins(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """(keys, columns): the row of the highest ``order`` of each key; combined on the map side, no sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_r")).select(*keys, "_r.*")


def first_wins(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_r")).select(*keys, "_r.*")


def ordered_children(parents: DataFrame, parent: str, ids: str, children: DataFrame, child: str, columns: list[str]) -> DataFrame:
    """(parent, position, child, columns): the children in the order of the id list of each parent; ids without a row are left out."""
    wanted = parents.select(parent, F.posexplode(ids).alias("position", child))
    return wanted.join(children.select(child, *columns), child).select(parent, "position", child, *columns)


def band_pairs(df: DataFrame, group: str, ident: str, value: str, width: float, keep: Column | None = None) -> DataFrame:
    """(group, id_a, id_b, value_a, value_b) of all pairs id_a < id_b of one group whose values differ by at most ``width``.

    Values meet in cells of ``width`` and the next cell, so pairs further apart are never formed. ``keep`` filters on those columns.
    """
    base = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(ident).alias("id"), F.col(value).alias("v"), F.floor(F.col(value) / F.lit(float(width))).cast("long").alias("_c"))
    a = base.withColumn("_c", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1))).alias("a")
    b = base.alias("b")
    on = (F.col("a.group") == F.col("b.group")) & (F.col("a._c") == F.col("b._c")) & (F.col("a.id") < F.col("b.id")) & (F.abs(F.col("a.v") - F.col("b.v")) <= width)
    out = a.join(b, on).select(F.col("a.group").alias(group), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.v").alias("value_a"), F.col("b.v").alias("value_b"))
    return out if keep is None else out.where(keep)


def nearest_on_line(probes: DataFrame, probe: str, at: str, points: DataFrame, point: str, place: str, group: list[str]) -> DataFrame:
    """(group, probe, at, point, place, distance): the nearest point of the same group for each probe; ties to the smaller place, then point.

    Probes and points are cut into CELLS equal cells between the least and the greatest value; the nearest point below or above is found by
    sorting within (group, cell) only, with the last point of earlier and the first of later cells carried in from one row a cell.
    Probes of groups without points are left out.
    """
    p = probes.where(F.col(at).isNotNull()).select(*group, F.col(probe).alias("_probe"), F.col(at).cast("double").alias("_v"), F.lit(None).cast(points.schema[point].dataType).alias("_point"))
    q = points.where(F.col(place).isNotNull()).groupBy(*group, F.col(place).cast("double").alias("_v")).agg(F.min(point).alias("_point"))
    q = q.select(*group, F.lit(None).cast(probes.schema[probe].dataType).alias("_probe"), "_v", "_point")
    both = p.unionByName(q)
    lo, hi = both.agg(F.min("_v"), F.max("_v")).head()
    if lo is None:
        lo = hi = 0.0
    width = max((hi - lo) / CELLS, 1e-300)
    both = both.withColumn("_cell", F.least(F.floor((F.col("_v") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(CELLS - 1)))
    here = F.when(F.col("_point").isNotNull(), F.struct(F.col("_v").alias("v"), F.col("_point").alias("p")))
    ends = both.groupBy(*group, "_cell").agg(F.max(here).alias("_top"), F.min(here).alias("_low"))
    w = Window.partitionBy(*group).orderBy("_cell")
    ends = ends.select(*group, "_cell", F.last("_top", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.first("_low", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    # A point sorts before a probe of the same value, so that it counts as below it.
    within = Window.partitionBy(*group, "_cell").orderBy("_v", F.col("_point").isNull(), "_point")
    near = both.withColumn("_b", F.last(here, True).over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first(here, True).over(within.rowsBetween(1, Window.unboundedFollowing)))
    near = near.where(F.col("_probe").isNotNull()).join(ends, [*group, "_cell"])
    best = F.array_min(F.filter(F.array(*[F.struct(F.abs(F.col("_v") - c["v"]).alias("d"), c["v"].alias("v"), c["p"].alias("p")) for c in (F.coalesce("_b", "_below"), F.coalesce("_a", "_above"))]), lambda x: x["v"].isNotNull()))
    out = near.withColumn("_n", best).where(F.col("_n").isNotNull())
    return out.select(*group, F.col("_probe").alias(probe), F.col("_v").alias(at), F.col("_n.p").alias(point), F.col("_n.v").alias(place), F.col("_n.d").alias("distance"))


def _spread_join(many: DataFrame, few: DataFrame, key: str, spread: str, salts: int = 8) -> DataFrame:
    """Equi-join in which the rows of a hot key of ``many`` go to ``salts`` tasks; ``few`` is repeated once a salt."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"]).drop("_salt")


def nearest_in_plane(probes: DataFrame, probe: str, points: DataFrame, point: str, xy: list[str], cell: float) -> DataFrame:
    """(probe, point, distance): the nearest point of each probe in two dimensions, ties to the smaller point. Null and NaN coordinates are left out.

    Points are put into a pyramid of square cells, each level's sixteen to one of the next; only occupied cells are kept. A probe starts at the top, and going
    down keeps the cells that can hold its nearest point: those whose nearest corner is no further than the furthest corner of the best one. So a probe far from all
    points meets the near edge of them only, never all. At the bottom (cells of ``cell``; choose it near the usual spacing) it is compared with the
    points in its cells. Steps from a level to the next are joins on the cell, hot cells salted. No probe gets a row if there are no points.
    """
    x, y = xy
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    there = points.where(ok(x) & ok(y)).groupBy(F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).agg(F.min(point).alias("_point"))
    rest = probes.where(ok(x) & ok(y)).select(F.col(probe).alias("_probe"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    there = cut_lineage(there.withColumn("_c", F.struct(F.floor(F.col("_px") / cell).cast("long").alias("i"), F.floor(F.col("_py") / cell).cast("long").alias("j"))))
    box = there.agg(F.min("_c.i"), F.max("_c.i"), F.min("_c.j"), F.max("_c.j")).head()
    if box[0] is None:
        return rest.select(F.col("_probe").alias(probe), F.lit(None).cast(points.schema[point].dataType).alias(point), F.lit(0.0).alias("distance")).where("false")
    depth = 0  # to the level on which all points lie in one cell, or in the four around the origin
    while depth < 31 and any((hi >> 2 * depth) - (lo >> 2 * depth) > 1 for lo, hi in (box[:2], box[2:])):
        depth += 1
    parent = F.struct(F.shiftright("_c.i", 2).alias("i"), F.shiftright("_c.j", 2).alias("j"))
    levels = [cut_lineage(there.select("_c").distinct())]
    for _ in range(depth):
        levels.append(cut_lineage(levels[-1].select(parent.alias("_c")).distinct()))
    tops = F.array(*[F.struct(F.lit(r["_c"]["i"]).alias("i"), F.lit(r["_c"]["j"]).alias("j")) for r in levels[-1].collect()])  # at most four cells
    open_ = rest.withColumn("_c", F.explode(tops))

    def bounded(cells: DataFrame, width: float) -> DataFrame:
        """Of each probe the cells, in _c, that may hold its nearest point."""
        low, high = lambda k, v: F.col(k) * width - F.col(v), lambda k, v: (F.col(k) + 1) * width - F.col(v)
        nearest = [F.greatest(F.lit(0.0), low(k, v), -high(k, v)) for k, v in (("_c.i", "_x"), ("_c.j", "_y"))]
        furthest = [F.greatest(F.abs(low(k, v)), F.abs(high(k, v))) for k, v in (("_c.i", "_x"), ("_c.j", "_y"))]
        d = cells.select("_probe", "_x", "_y", "_c", F.hypot(*nearest).alias("near"), F.hypot(*furthest).alias("far"))
        held = d.groupBy("_probe", "_x", "_y").agg(F.min("far").alias("_most"), F.collect_list(F.struct("near", "_c")).alias("_all"))
        # A hair of slack for rounding; equal distances stay, as ties go to the smaller point.
        keep = F.filter("_all", lambda c: c["near"] <= F.col("_most") * (1 + 1e-9) + 1e-12)
        return held.select("_probe", "_x", "_y", F.explode(F.transform(keep, lambda c: c["_c"])).alias("_c"))

    for level in range(depth, 0, -1):
        below = levels[level - 1].select(F.col("_c").alias("_child"), parent.alias("_c"))
        down = _spread_join(open_, below, "_c", "_probe").select("_probe", "_x", "_y", F.col("_child").alias("_c"))
        open_ = cut_lineage(bounded(down, cell * 4.0 ** (level - 1)))
    near = _spread_join(open_, there, "_c", "_probe")
    gap = F.sqrt((F.col("_px") - F.col("_x")) * (F.col("_px") - F.col("_x")) + (F.col("_py") - F.col("_y")) * (F.col("_py") - F.col("_y")))
    best = near.groupBy("_probe", "_x", "_y").agg(F.min(F.struct(gap.alias("distance"), F.col("_point").alias("point"))).alias("_b"))
    return best.select(F.col("_probe").alias(probe), F.col("_b.point").alias(point), F.col("_b.distance").alias("distance"))


def in_boxes(points: DataFrame, coords: list[str], boxes: DataFrame, box: str, cell: float, pad: float = 0.0) -> DataFrame:
    """Points with the id of every box that holds them, borders included. ``boxes`` has <c>_min and <c>_max for each coordinate c.

    Both sides meet in a grid over the first coordinate, cells of ``cell``: a box is repeated once a cell it spans (choose ``cell`` near
    the usual box length). ``pad`` widens the boxes on all sides.
    """
    first = coords[0]
    wide = boxes.select(F.col(box).alias("_box"), *[(F.col(f"{c}_min") - pad).alias(f"_lo_{c}") for c in coords], *[(F.col(f"{c}_max") + pad).alias(f"_hi_{c}") for c in coords])
    at = lambda c: F.floor(c / F.lit(float(cell))).cast("long")
    spread = wide.where(F.col(f"_lo_{first}") <= F.col(f"_hi_{first}")).withColumn("_c", F.explode(F.sequence(at(F.col(f"_lo_{first}")), at(F.col(f"_hi_{first}")))))
    holds = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in coords])
    joined = points.withColumn("_c", at(F.col(first))).join(spread, "_c").where(holds)
    return joined.select(*points.columns, F.col("_box").alias(box))


def pareto_frontier(df: DataFrame, ident: str, x: str, y: str) -> DataFrame:
    """Rows that no other row dominates (at least as good in both of x and y, larger is better, and better in one). Equal rows both stay.

    Instead of comparing pairs: a row is dominated if a larger x has at least its y, or an equal x has more. The best y of larger x comes from
    one row a cell of x, and a sort within the cell. Rows with a null coordinate are left out.
    """
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(ident, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    best = base.groupBy("_x").agg(F.max("_y").alias("_top"))
    lo, hi = best.agg(F.min("_x"), F.max("_x")).head()
    if lo is None:
        lo = hi = 0.0
    width = max((hi - lo) / CELLS, 1e-300)
    best = best.withColumn("_c", F.least(F.floor((F.col("_x") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(CELLS - 1)))
    cells = best.groupBy("_c").agg(F.max("_top").alias("_t"))
    cells = cells.select("_c", F.max("_t").over(Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    inside = F.max("_top").over(Window.partitionBy("_c").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_in", inside).join(F.broadcast(cells), "_c").withColumn("_right", F.greatest("_in", "_later"))
    front = best.where(F.col("_right").isNull() | (F.col("_top") > F.col("_right"))).select(F.col("_x"), F.col("_top").alias("_y"))
    return base.join(front, ["_x", "_y"]).select(ident, F.col("_x").alias(x), F.col("_y").alias(y))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, after a check that no key occurs twice; raises with some of those that do."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(10).collect()
    if twice:
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in twice]}")
    return df


def require_present(df: DataFrame, key: str, index: DataFrame, index_key: str) -> DataFrame:
    """``df`` itself, after a check that every key is in the index; raises with the first ten that are not."""
    missing = df.join(index, df[key] == index[index_key], "left_anti").select(key).limit(10).collect()
    if missing:
        raise ValueError(f"not in the index: {[r[0] for r in missing]}")
    return df
