"""Settings of a benchmark build, checked before any job starts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import cycle, islice

# Names of the engines.
ENGINES = ("thor", "interiorgs")


@dataclass(frozen=True)
class BuildConfig:
    """``scenes``: scene names per engine. A group should have ``group_size`` clips and is dropped with fewer than ``min_group_size``. ``radii``: distances
    at which circular paths are taken, of which a group uses ``radius_count``."""

    group_size: int = 30
    min_group_size: int = 25
    engines: tuple[str, ...] = ENGINES
    scenes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    radii: tuple[float, ...] = (1.0, 1.5, 2.0)
    radius_count: int = 3

    def problems(self) -> list[str]:
        """What is wrong with the settings, in words; empty if nothing is."""
        unknown = sorted(set(self.engines) - set(ENGINES))
        bare = [e for e in self.engines if e in ENGINES and not self.scenes.get(e)]
        twice = sorted(e for e, names in self.scenes.items() if len(set(names)) < len(names))
        found = {
            f"group sizes {self.min_group_size} to {self.group_size} make no range above 0": not 0 < self.min_group_size <= self.group_size,
            "no engine is named": not self.engines,
            f"unknown engines: {', '.join(unknown)}": bool(unknown),
            f"engines without scenes: {', '.join(bare)}": bool(bare),
            f"engines with repeated scenes: {', '.join(twice)}": bool(twice),
            "radii must be positive, and some must be used": not self.radii or min(self.radii) <= 0 or self.radius_count < 1,
        }
        return [text for text, holds in found.items() if holds]

    def checked(self) -> BuildConfig:
        """The settings themselves; raises with all problems at once."""
        if wrong := self.problems():
            raise ValueError("; ".join(wrong))
        return self

    def radii_of_a_group(self) -> tuple[float, ...]:
        return evenly_chosen(self.radii, self.radius_count)


def evenly_chosen(values: Iterable[float], count: int) -> tuple[float, ...]:
    """``count`` values out of the distinct ones in rising order, evenly spaced from the least to the greatest (halves go up); all of them over and over where they do not suffice."""
    there = sorted(set(values))
    if not there or count < 1:
        raise ValueError("there must be a value and a count")
    if count > len(there):
        return tuple(islice(cycle(there), count))
    gaps, last = max(1, count - 1), len(there) - 1
    return tuple(there[(2 * i * last + gaps) // (2 * gaps)] for i in range(count))
