"""Motion settings keep their number of cycles."""

from pyspark.sql import functions as F

from evalloom.llm.queries import motion_settings, p2_densities


def test_large_cycle_counts_stay_apart(spark, tmp_path):
    rows = [(f"c{i}", "passby", "cw", 0.0, n) for i, n in enumerate([None, 3, 20, 21] + [400] * 50)]
    df = spark.createDataFrame(rows, "clip_id string, trajectory string, direction string, start_angle_offset double, cycle_count int")
    df.withColumn("ingested_at", F.lit("2026-01-01 00:00:00").cast("timestamp")).write.parquet(f"{tmp_path}/clips.parquet")
    spark.createDataFrame([("varied_subset_size", 3.0)], "setting string, amount double").write.parquet(f"{tmp_path}/plan_settings.parquet")
    assert sorted(r["cycles"] for r in motion_settings(spark, str(tmp_path)).collect()) == [-1, 3, 20, 21] + [400] * 50
    density = {r["cycles"]: r["density"] for r in p2_densities(spark, str(tmp_path)).collect()}
    assert density[400] == 50 and density[21] < 5


def test_unknown_angles_are_no_real_setting(spark, tmp_path):
    angles = [0.0, 359.6, -90.0, 1e12, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(f"c{i}", "passby", "cw", a, 1) for i, a in enumerate(angles)], "clip_id string, trajectory string, direction string, start_angle_offset double, cycle_count int")
    df.withColumn("ingested_at", F.lit("2026-01-01 00:00:00").cast("timestamp")).write.parquet(f"{tmp_path}/clips.parquet")
    got = {r["clip_id"]: r["angle"] for r in motion_settings(spark, str(tmp_path)).collect()}
    assert [got[f"c{i}"] for i in range(7)] == [0, 0, 270, int(1e12) % 360, -1, -1, -1]
