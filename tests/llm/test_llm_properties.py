"""Properties of packing, repair and text pieces on random inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.llm.byte_cnn import WINDOW, windows, wrongly_decoded
from evalloom.llm.language import repaired, units
from evalloom.llm.packing import pack
from evalloom.llm.quota_sample import repair
from evalloom.llm.stable import raise_thresholds


@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 60)), max_size=80), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_pack(items, segments):
    sizes = np.array([(a, 1, min(a, b)) for a, b in items], float).reshape(-1, 3)
    at = pack(sizes, (100.0, float(segments), 60.0))
    sums = np.zeros((len(items) + 1, 3))
    np.add.at(sums, at, sizes)
    assert (at >= 0).all() and (sums <= np.array([100, segments, 60]) + 1e-9).all()
    assert set(at.tolist()) == set(range(at.max() + 1)) if len(at) else True


@given(st.dictionaries(st.tuples(st.sampled_from("pqr"), st.sampled_from(["u", "v", None])), st.integers(1, 60)), st.integers(0, 200), st.lists(st.integers(0, 30), min_size=5, max_size=5))
@settings(max_examples=60, deadline=None)
def test_repair(counts, size, floors):
    targets = {k: (0.3, f) for k, f in zip([(0, "p"), (0, "q"), (0, "r"), (1, "u"), (1, "v")], floors, strict=True)}
    take = repair(counts, targets, size)
    assert sum(take.values()) == min(size, sum(counts.values())) and all(0 < n <= counts[s] for s, n in take.items())


@given(st.binary(max_size=700))
def test_windows_cover(data):
    parts = windows(data)
    assert all(len(p) <= WINDOW for p in parts) and parts[0] == data[:WINDOW] and data.endswith(parts[-1]) and len(parts) <= -(-len(data) // WINDOW) + 1


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_units_of_any_text(text):
    found = units(text)
    assert all(0 <= a <= b <= len(text) and n >= 0.5 for a, b, _, n in found) and [u[0] for u in found] == sorted(u[0] for u in found)


@given(st.text("abcäöüéèñçßřš 中文шю", max_size=60))
def test_repair_of_wrong_decoding(text):
    assert repaired(wrongly_decoded(text))[0] == text


@given(st.dictionaries(st.sampled_from(["", "a", "b"]), st.floats(0, 1)), st.dictionaries(st.sampled_from(["a", "b", "c"]), st.floats(0, 1)), st.one_of(st.none(), st.floats(0, 1)))
def test_thresholds_never_fall(earlier, rates, default):
    new = raise_thresholds(rates, earlier, default)
    for stratum in ("a", "b", "c", "zzz"):
        assert new.get(stratum, new.get("", 0.0)) >= earlier.get(stratum, earlier.get("", 0.0))
