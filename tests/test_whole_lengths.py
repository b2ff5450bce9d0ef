"""Lengths with units in the chance baseline."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from evalloom.functions import parse


def test_lengths_with_units_count(spark, tmp_path):
    texts = {"1.2": 1.2, "120 cm": 1.2, "1200mm": 1.2, "1.2 m": 1.2, "~1.2 metres": 1.2, "1,2": 1.2, "3e1": 30.0, " 2 ": 2.0, "2 feet": None, "none": None, "": None, None: None}
    df = spark.createDataFrame([("size", t) for t in texts], "question_type string, ground_truth string")
    got = df.select("ground_truth", parse.length_metres(F.col("ground_truth")).alias("m")).collect()
    assert {r["ground_truth"]: r["m"] for r in got} == texts
    df.where("ground_truth not in ('3e1', ' 2 ')").write.parquet(f"{tmp_path}/clips.parquet")
    # Of the constants that score 1 everywhere the smallest: 1.2 x 0.95.
    assert [tuple(r) for r in entry.queries()["chance_baseline"](spark, str(tmp_path)).collect()] == [("size", 1.14, 1.0, 6)]
