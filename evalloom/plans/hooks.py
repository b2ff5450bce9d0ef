"""Evaluation tasks by name: how rows are checked, asked, scored and summed up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

_REGISTRY: dict[str, Callable] = {}


def hook(name: str) -> Callable:
    """Registers a function under a name, so that a task definition can refer to it."""

    def add(f: Callable) -> Callable:
        if name in _REGISTRY:
            raise ValueError(f"hook {name!r} exists")
        _REGISTRY[name] = f
        return f

    return add


def resolve(name: str | Callable) -> Callable:
    if callable(name):
        return name
    if name not in _REGISTRY:
        raise KeyError(f"no hook {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]


@dataclass(frozen=True)
class Task:
    """``prompt`` and the ``process`` steps map rows to rows, ``aggregate`` rows to a table of metrics; each a hook name or a function."""

    name: str
    prompt: str | Callable[[], Column]
    process: str | Callable[[DataFrame], DataFrame]
    aggregate: str | Callable[[DataFrame], DataFrame]
    validate: str | Callable[[DataFrame], DataFrame] | None = None
    options: dict = field(default_factory=dict)

    def run(self, docs: DataFrame) -> DataFrame:
        checked = resolve(self.validate)(docs) if self.validate else docs
        return resolve(self.aggregate)(resolve(self.process)(checked))
