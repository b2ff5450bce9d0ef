"""Queries over whole tables, against plain counts in Python."""

import json
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows_of(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


def test_boxes_of_all_parts(spark):
    events = [(e["value"], json.loads(e["props"])["k"]) for e in rows_of(spark, "events") if e["value"] is not None]
    expected = {p["p_partkey"]: sum(p["p_size"] * 3.0 <= v <= p["p_size"] * 3.0 + 0.5 and 10 <= k <= 10 + p["p_partkey"] % 7 for v, k in events) for p in rows_of(spark, "part")}
    got = {r["p_partkey"]: r["events"] for r in entry.queries()["box_range_join"](spark, DATA).collect()}
    assert got == {k: n for k, n in expected.items() if n}
    assert any(p["p_size"] > 10 and p["p_partkey"] in got for p in rows_of(spark, "part"))


def test_all_customers_are_filled_and_counted(spark):
    customers = [(c["c_nationkey"], c["c_custkey"], c["c_mktsegment"]) for c in rows_of(spark, "customer")]
    nations = {}
    for n, k, _ in sorted(customers):
        nations.setdefault(n, []).append(k)
    levels = sorted((i + 1, n, k) for n, ks in nations.items() for i, k in enumerate(ks))[:60]
    got = sorted((r["level"], r["c_nationkey"], r["c_custkey"]) for r in entry.queries()["water_fill"](spark, DATA).collect())
    assert got == levels
    table = entry.queries()["crosstab_pivot"](spark, DATA).collect()
    assert sum(v for r in table for c, v in r.asDict().items() if c != "c_nationkey") == len(customers)
