"""Frames of a path: whether an object's box is usable in one, and how good a run of frames is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least share of the picture that a box takes, and how far its centre may be from the picture's, as shares of width and height, by motion pattern. None: anywhere.
BOX_LIMITS = {"passby": (1.0 / 700.0, 0.48, 0.4), "spherical": (0.01, 0.28, 0.28), "approach": (0.01, 0.2, 0.25), None: (0.01, None, None)}
# Weight of the mean share, and of what a pattern asks of a run.
AREA_WEIGHT, PATTERN_WEIGHT = 1000, 100
#: A change of less is none.
STILL = 1e-6


def usable_box(pattern: Column, area: Column, cx: Column, cy: Column, least: float | None = None) -> Column:
    """Whether a box of that share of the picture, with its centre there (as shares of width and height), will do for a motion pattern. ``least``: another least
    share for patterns but passby, whose boxes are small."""

    def within(name: str | None) -> Column:
        smallest, *far = BOX_LIMITS[name]
        smallest = smallest if least is None or name == "passby" else least
        middles = [F.abs(c - 0.5) <= d + 1e-12 for c, d in zip((cx, cy), far, strict=True) if d is not None]
        return reduce(lambda a, b: a & b, middles, area >= smallest)

    return reduce(lambda rest, name: F.when(pattern == name, within(name)).otherwise(rest), [n for n in BOX_LIMITS if n], within(None))


def _steps_right(values: Column, rising: Column) -> Column:
    """Share of the steps of an array that go the right way, steps below STILL left out; 1 if there is none."""
    n = F.size(values)
    steps = F.when(n > 1, F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(1))), F.slice(values, 1, F.greatest(n - 1, F.lit(1))), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))
    moved = F.filter(steps, lambda d: F.abs(d) >= STILL)
    right = F.filter(moved, lambda d: F.when(rising, d > 0).otherwise(d < 0))
    return F.coalesce(F.try_divide(F.size(right).cast("double"), F.size(moved)), F.lit(1.0))


def run_quality(pattern: Column, direction: Column, areas: Column, centres: Column) -> Column:
    """Quality of a run: a thousand times the mean area share, plus, by pattern, up to a hundred each for growing (or shrinking) boxes when
    approaching, for moving steadily and far across the picture when passing, and for staying in the middle on a sphere. 0 for no frames."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    base = mean(areas) * AREA_WEIGHT
    span = F.array_max(centres) - F.array_min(centres)
    away = mean(F.transform(centres, lambda c: F.abs(c - 0.5)))
    extra = (
        F.when(pattern == "approach", _steps_right(areas, direction == "fw") * PATTERN_WEIGHT)
        .when(pattern == "passby", (_steps_right(centres, direction == "bw") + span) * PATTERN_WEIGHT)
        .when(pattern == "spherical", (1 - away) * PATTERN_WEIGHT)
        .otherwise(0.0)
    )
    return F.when(F.size(areas) > 0, base + extra).otherwise(0.0)
