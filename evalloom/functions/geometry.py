"""Points, boxes, cameras and paths as column expressions. Points are structs of x, y, z (y up) or arrays of three; angles are in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extents(corners: Column) -> Column:
    """Lengths along the three axes of an array of corner points (arrays of three), as struct dx, dy, dz."""

    def axis(i: int) -> Column:
        c = F.transform(corners, lambda p: F.get(p, F.lit(i)).cast("double"))
        return F.array_max(c) - F.array_min(c)

    return F.struct(axis(0).alias("dx"), axis(1).alias("dy"), axis(2).alias("dz"))


def object_size(corners: Column) -> Column:
    """Struct length, width, height: the longer and shorter side of the base, and the vertical side."""
    e = extents(corners)
    return F.struct(F.greatest(e["dx"], e["dz"]).alias("length"), F.least(e["dx"], e["dz"]).alias("width"), e["dy"].alias("height"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def flat_distance(ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    return F.hypot(ax - bx, az - bz)


def is_near(d: Column, limit: float) -> Column:
    return d <= limit


def is_outside(d: Column, limit: float) -> Column:
    return d > limit


def ratio(a: Column, b: Column) -> Column:
    """Larger over smaller; null if the smaller is 0."""
    return F.try_divide(F.greatest(a, b), F.least(a, b))


def heading(dx: Column, dz: Column) -> Column:
    """Angle of a direction from the z axis, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dz)), F.lit(360.0))


def pitch_to(dy: Column, flat: Column, low: float = -30.0, high: float = 60.0) -> Column:
    """Downward angle to a point ``dy`` higher at a flat distance, clipped to what a camera can do."""
    return F.least(F.lit(high), F.greatest(F.lit(low), -F.degrees(F.atan2(dy, flat))))


def in_camera_frame(dx: Column, dy: Column, dz: Column, yaw: Column) -> Column:
    """Offset (right, up, forward) seen by a camera turned by ``yaw`` from the z axis."""
    a = F.radians(yaw)
    return F.struct((dx * F.cos(a) - dz * F.sin(a)).alias("right"), dy.alias("up"), (dx * F.sin(a) + dz * F.cos(a)).alias("forward"))


def project(dx: Column, dy: Column, dz: Column, yaw: Column, pitch: Column, fov: float, width: int, height: int, near: float = 0.1) -> Column:
    """Pixel (u, v) and depth of an offset from the camera; null behind the near plane. ``fov`` is vertical."""
    turned = in_camera_frame(dx, dy, dz, yaw)
    p = F.radians(pitch)
    depth = turned["forward"] * F.cos(p) - turned["up"] * F.sin(p)
    up = turned["forward"] * F.sin(p) + turned["up"] * F.cos(p)
    focal = F.lit(height / 2.0) / F.tan(F.radians(F.lit(fov / 2.0)))
    inside = F.struct((F.lit(width / 2.0) + focal * turned["right"] / depth).alias("u"), (F.lit(height / 2.0) - focal * up / depth).alias("v"), depth.alias("depth"))
    return F.when(depth > near, inside)


def visible_corners(pixels: Column, width: int, height: int) -> Column:
    """How many projected points (structs u, v or null) lie in the picture."""
    return F.size(F.filter(pixels, lambda p: p.isNotNull() & p["u"].between(0, width) & p["v"].between(0, height)))


def box_of(points: Column) -> Column:
    """Smallest axis-parallel box of an array of points (arrays of three): struct lo, hi of arrays."""

    def side(f) -> Column:
        pick = [lambda p: F.get(p, F.lit(0)), lambda p: F.get(p, F.lit(1)), lambda p: F.get(p, F.lit(2))]
        return F.array(*[f(F.transform(points, p)) for p in pick])

    return F.struct(side(F.array_min).alias("lo"), side(F.array_max).alias("hi"))


def volume(box: Column) -> Column:
    return F.aggregate(F.zip_with(box["hi"], box["lo"], lambda h, lo: F.greatest(h - lo, F.lit(0.0)).cast("double")), F.lit(1.0), lambda a, x: a * x)


def overlap_volume(a: Column, b: Column) -> Column:
    """Volume common to two boxes; 0 if they are apart."""
    sides = F.zip_with(F.zip_with(a["hi"], b["hi"], lambda x, y: F.least(x, y)), F.zip_with(a["lo"], b["lo"], lambda x, y: F.greatest(x, y)), lambda h, lo: F.greatest(h - lo, F.lit(0.0)).cast("double"))
    return F.aggregate(sides, F.lit(1.0), lambda s, x: s * x)


def contains(outer: Column, inner: Column, share: float = 0.9, same_floor: float = 0.01) -> Column:
    """Whether at least ``share`` of the inner box's volume lies in the outer one. Boxes whose floors are within ``same_floor`` stand side by side on something, so neither holds the other;
    a box without volume is in none."""
    lies_in = F.try_divide(overlap_volume(outer, inner), volume(inner)) >= share
    beside = F.abs(outer["lo"][1] - inner["lo"][1]) < same_floor
    return F.coalesce(lies_in & (volume(inner) > 1e-9) & ~beside, F.lit(False))


def rests_on(lower: Column, upper: Column, gap: float = 0.05) -> Column:
    """Whether the upper box stands on the lower one: its floor within ``gap`` of the other's top, and their bases overlap."""
    apart = F.abs(upper["lo"][1] - lower["hi"][1]) <= gap
    over = lambda i: (upper["lo"][i] < lower["hi"][i]) & (lower["lo"][i] < upper["hi"][i])
    return apart & over(0) & over(2)


def area_2d(u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    return F.greatest(u1 - u0, F.lit(0.0)) * F.greatest(v1 - v0, F.lit(0.0))


def area_share(u0: Column, v0: Column, u1: Column, v1: Column, width: int, height: int) -> Column:
    return area_2d(u0, v0, u1, v1) / F.lit(float(width * height))


def centre_offset(u0: Column, v0: Column, u1: Column, v1: Column, width: int, height: int) -> Column:
    """Distance of the box centre from the picture centre as a share of half the diagonal."""
    return F.hypot((u0 + u1) / 2 - width / 2.0, (v0 + v1) / 2 - height / 2.0) / F.lit((width**2 + height**2) ** 0.5 / 2)


def occluded_share(depths: Column, own: Column, slack: float = 0.05) -> Column:
    """Share of sampled depths that are nearer than the object by more than ``slack``."""
    return F.try_divide(F.size(F.filter(depths, lambda d: d < own - slack)).cast("double"), F.size(depths))


def orbit(cx: Column, cz: Column, radius: Column, start: Column, steps: int, clockwise: bool = True) -> Column:
    """``steps`` poses on a circle that look at its centre: array of structs angle, x, z, yaw."""
    turn = (1 if clockwise else -1) * 360.0 / steps

    def pose(i: Column) -> Column:
        a = F.pmod(start + i * F.lit(turn), F.lit(360.0))
        return F.struct(a.alias("angle"), (cx + radius * F.sin(F.radians(a))).alias("x"), (cz + radius * F.cos(F.radians(a))).alias("z"), F.pmod(a + 180, F.lit(360.0)).alias("yaw"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), pose)


def spiral(cx: Column, cz: Column, first: Column, last: Column, turns: float, steps: int) -> Column:
    """Poses on a circle whose radius changes evenly from first to last."""

    def pose(i: Column) -> Column:
        t = i / F.lit(float(max(1, steps - 1)))
        a, r = F.pmod(t * F.lit(360.0 * turns), F.lit(360.0)), first + (last - first) * t
        return F.struct(a.alias("angle"), (cx + r * F.sin(F.radians(a))).alias("x"), (cz + r * F.cos(F.radians(a))).alias("z"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), pose)


def straight(ax: Column, az: Column, bx: Column, bz: Column, steps: int) -> Column:
    """Evenly spaced points from a to b, ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct((ax + (bx - ax) * i / F.lit(float(max(1, steps - 1)))).alias("x"), (az + (bz - az) * i / F.lit(float(max(1, steps - 1)))).alias("z")))


def all_or_nothing(poses: Column, valid) -> Column:
    """The poses if every one is valid, else null."""
    return F.when(F.forall(poses, valid), poses)


def linear_steps(length: Column, step: float, least: int = 2) -> Column:
    """Poses of a straight path."""
    return F.greatest(F.lit(least), F.floor(length / F.lit(step)) + 1)


def distance_buckets(low: float, high: float, step: float) -> Column:
    """The bucket values low, low + step, ... up to high, to one decimal."""
    return F.transform(F.sequence(F.lit(0), F.lit(int(round((high - low) / step)))), lambda i: F.round(F.lit(low) + i * F.lit(step) + F.lit(1e-9), 1))


def round_up_ties(x: Column) -> Column:
    """One decimal, ties upwards: a nudge of 1e-9 before rounding."""
    return F.round(x + F.lit(1e-9), 1)
