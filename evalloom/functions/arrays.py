"""Predicates and small folds over arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def subset(a: Column, b: Column) -> Column:
    """Every element of a is in b; true for an empty a, null for a null array."""
    return F.size(F.array_except(a, b)) == 0


def disjoint(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) == 0


def any_in(a: Column, values: list) -> Column:
    return F.exists(a, lambda x: x.isin(*values))


def in_all(lists: Column) -> Column:
    """Elements common to all arrays of an array of arrays."""
    return F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)), lambda a, x: F.array_intersect(a, x))


def covisible_frames(anchors: Column, frames: Column) -> Column:
    """How many frames of a map frame -> ids show all anchors."""
    return F.size(F.map_filter(frames, lambda k, ids: F.size(F.array_except(anchors, ids)) == 0))


def nested_get(m: Column, *path: str) -> Column:
    """A value in nested maps; null if a key is missing."""
    for p in path:
        m = F.try_element_at(m, F.lit(p))
    return m
