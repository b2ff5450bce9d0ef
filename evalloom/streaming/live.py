"""Running scores of evaluation samples as they arrive (an extension: batch is the usual mode)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalloom.functions.metrics import scored
from evalloom.operators.consistency import mean_group_cv


def sample_stream(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 100, fmt: str = "json") -> DataFrame:
    """Files of a folder, or of a glob (which may match a single file), as a stream, a bounded number each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(folder)


def running_scores(samples: DataFrame, group: str, pred: str, target: str, time: str | None = None, late: str = "1 hour", window: str | None = None) -> DataFrame:
    """(window, group, n, mra, cape, mean, std): one stateful aggregation; with a time column, windows are closed ``late`` after they end."""
    keys = [group]
    if time:
        samples = samples.withWatermark(time, late)
        if window:
            keys = [F.window(time, window).alias("window"), group]
    p, t = F.col(pred).cast("double"), F.col(target).cast("double")
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(scored("mra", p, t)).alias("mra"), F.avg(scored("cape", p, t)).alias("cape"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std")
    )


def slice_reports(scores: DataFrame, axis: str, group: str, out: str, checkpoint: str) -> StreamingQuery:
    """Level two in each batch, since stateful aggregations do not chain in update mode: mean dispersion per ``axis`` of the groups so far, written to ``out``."""

    def report(batch: DataFrame, number: int) -> None:
        cv = F.when((F.col("n") >= 2) & (F.col("mean") > 0), F.col("std") / F.col("mean"))
        mean_group_cv(batch.withColumn("cv", cv), [axis]).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return scores.writeStream.outputMode("complete").foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_sink(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Rows appended to files exactly once, resumable from the checkpoint."""
    return stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
