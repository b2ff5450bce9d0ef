"""All queries over the driver's tables, with their SQL, gathered from the modules of this package."""

from __future__ import annotations

from evalloom.plans import building, exchange, places, scoring, selecting, shaping

MODULES = (scoring, shaping, selecting, places, building, exchange)


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        for name, pair in m.catalog().items():
            if name in out:
                raise ValueError(f"two queries are named {name}")
            out[name] = pair
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracles() -> dict:
    return {k: s for k, (_, s) in _all().items() if s}
