"""Properties of the driver-side allocation rules on random inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from evalloom.operators import consistency, greedy, windows
from evalloom.plans import config

CAPS = st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 40))


@given(CAPS, st.integers(0, 200))
@settings(max_examples=200, deadline=None)
def test_fair_targets(caps, total):
    got = windows.fair_targets(caps, total)
    assert sum(got.values()) == min(total, sum(caps.values())) and all(0 <= got[k] <= caps[k] for k in caps)
    # Nobody with room left has two fewer than another.
    open_levels = [got[k] for k in caps if got[k] < caps[k]]
    assert not open_levels or max(got.values()) <= min(open_levels) + 1


@given(CAPS, st.integers(0, 200))
@settings(max_examples=200, deadline=None)
def test_adaptive_targets(caps, total):
    got = greedy.adaptive_targets(caps, total)
    assert all(0 <= got[k] <= caps[k] for k in caps) and (not caps or sum(got.values()) == min(total, sum(caps.values())))


@given(st.integers(0, 500), st.integers(1, 30))
def test_quotas(total, n):
    got = windows.quotas(total, n)
    assert sum(got) == total and len(got) == n and max(got) - min(got) <= 1


@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), max_size=30), st.integers(1, 6))
def test_shards(sizes, shards):
    got = greedy.longest_first_shards(sizes, shards)
    load = [sum(n for k, n in sizes.items() if got[k] == i) for i in range(shards)]
    assert set(got) == set(sizes) and (not sizes or max(load) - min(load) <= max(sizes.values()))


@given(st.lists(st.floats(0.1, 5), min_size=1, max_size=20), st.integers(1, 12))
def test_spread(values, count):
    got = config.evenly_chosen(tuple(values), count)
    assert len(got) == count and set(got) <= set(values) and (count == 1 or len(set(values)) < count or (got[0], got[-1]) == (min(values), max(values)))


@given(st.floats(-0.999, 0.999), st.integers(3, 400))
@settings(max_examples=200, deadline=None)
def test_p_value(r, n):
    p = consistency.correlation_p_value(r, n)
    assert -1e-9 <= p <= 1 + 1e-9 and abs(p - consistency.correlation_p_value(-r, n)) < 1e-9
    assert p >= consistency.correlation_p_value(min(0.9999, abs(r) + 0.0005), n) - 1e-9
