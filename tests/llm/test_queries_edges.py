"""Every training-data query on empty tables, on rows of nulls, and on repeated rows."""

import os

import pytest
from pyspark.sql import functions as F

from evalloom.llm.capping import cap_per_contributor
from evalloom.llm.overlap import overlap_pairs
from evalloom.llm.packing import pack_texts
from evalloom.llm.queries import llm_queries

DATA = "/root/testdata/sf0.001"
GROWING = ["clips", "consistency_groups", "candidate_groups", "documents"]
FIXED = ["plan_settings", "split_targets", "source_weights", "sample_targets", "lang_samples"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for kind in ("empty", "nulls", "twice"):
        for name in GROWING:
            df = spark.read.parquet(f"{DATA}/{name}.parquet")
            if kind == "empty":
                out = df.limit(0)
            elif kind == "nulls":
                out = spark.createDataFrame([tuple([None] * len(df.columns))] * 3, df.schema)
            else:
                out = df.unionAll(df).withColumn("kept", F.lit(1)).withColumn("_c", F.lit("x")).withColumn("stratum", F.lit(None).cast("int"))
            out.write.parquet(f"{root}/{kind}/{name}.parquet")
        for name in FIXED:
            spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{root}/{kind}/{name}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_empty_and_null_tables(spark, folders, name):
    run = llm_queries()[name]
    for kind in ("empty", "nulls"):
        rows = run(spark, f"{folders}/{kind}").collect()
        if name.endswith("found") and name != "p4_found":
            assert rows == []
        if name == "p4_found":
            assert len(rows) == 17  # every target falls short


@pytest.mark.parametrize("name", ["p1_found", "p2_varied_subset", "p3_found", "p3_splits", "p4_found", "p4_target_sample", "p5_found", "p6_stable_sample"])
def test_repeated_rows_change_nothing(spark, folders, name):
    run = llm_queries()[name]
    assert sorted(map(str, run(spark, f"{folders}/twice").collect())) == sorted(map(str, run(spark, DATA).collect()))


def test_operators_on_repeated_rows(spark):
    rows = spark.createDataFrame([("a", "s", 1.0), ("a", "s", 1.0), ("b", "s", 2.0), (None, "s", 1.0)], "i string, c string, v double")
    assert sorted(str(r["i"]) for r in cap_per_contributor(rows, "i", "c", "v", 2, best=True).where("kept").collect()) == ["None", "b"]
    pairs = spark.createDataFrame([("e", True, "p", ["x"], 1.0), ("t", False, "p", ["x"], 1.0), ("t", False, "p", ["x"], 1.0)], "i string, ev boolean, p string, w array<string>, v double")
    assert overlap_pairs(pairs, "i", "ev", F.col("p"), "w", "v", 0.1).count() == 2
    items = spark.createDataFrame([(1, 60, 5)] * 3, "d bigint, n bigint, p bigint")
    packed = pack_texts(items, "d", "n", "p", 100).collect()
    assert len(packed) == 3 and len({r["container"] for r in packed}) == 3
