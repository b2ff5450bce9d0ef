"""The entry gives the core queries even where the training-data subpackage cannot be imported."""

import importlib
import sys

import __spark_entry__ as entry


def test_missing_dependency_keeps_the_core(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("evalloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("tiktoken", "xxhash", "evalloom.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    importlib.invalidate_caches()
    names = set(entry.queries())
    assert "score_breakdown" in names and not any(n.startswith("p1_") for n in names)
    assert set(entry.oracle_sql()) <= names
