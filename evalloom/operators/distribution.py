"""Distribution reports: counts with shares, joint counts, bins, crosstabs and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_table(df: DataFrame, key: str, total: int | None = None, digits: int = 1, percent: bool = True, drop_null: bool = True) -> DataFrame:
    """(key, n, share): counts and their share of ``total`` (of the counted rows if not given, never less than 1), most first, then by name.

    Reports that divide by all rows, nulls included, pass the count of all rows as ``total``.
    """
    rows = df.where(F.col(key).isNotNull()) if drop_null else df
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # A scalar subquery rather than a window over everything, which would bring all counts to one task.
    whole = F.lit(max(1, total)) if total is not None else rows.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.round(F.lit(100.0 if percent else 1.0) * F.col("n") / whole, digits)).orderBy(F.desc("n"), F.col(key).cast("string"))


def joint_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) for rows that have all keys."""
    out = df
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def many_distributions(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n) of several columns in one pass and one shuffle; nulls are left out."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("p")).select("p.*")
    return pairs.where(F.col("value").isNotNull()).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def angle_bin(angle: Column, width: int = 30) -> Column:
    """Label of the bin of an angle in degrees, turned into [0, 360): '030-059'."""
    low = (F.floor(F.pmod(angle, F.lit(360.0)) / width) * width).cast("int")
    return F.format_string("%03d-%03d", low, low + width - 1)


def top_per_group(df: DataFrame, group: list[str], item: str, most: int) -> DataFrame:
    """(group, item, n, position): the ``most`` most frequent items of each group, ties by name."""
    counts = df.where(F.col(item).isNotNull()).groupBy(*group, item).agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), F.col(item)))
    return counts.withColumn("position", at).where(F.col("position") <= most)


def crosstab(df: DataFrame, row: str, column: str, rows: DataFrame, values: list) -> DataFrame:
    """Counts of ``column`` values per ``row``, with a row of zeros for each row value of ``rows`` that does not occur."""
    table = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    return rows.join(table, row, "left").fillna(0, [str(v) for v in values])


def conversation_stats(df: DataFrame, conversations: str, modality: Column) -> DataFrame:
    """(modality, n, turns, questions, mean_answer_chars) of training conversations (arrays of structs from, value)."""
    c = F.col(conversations)
    answers = F.filter(c, lambda x: x["from"] == "gpt")
    chars = F.aggregate(answers, F.lit(0), lambda a, x: a + F.coalesce(F.length(x["value"]), F.lit(0)))
    out = df.select(modality.alias("modality"), F.size(c).alias("_t"), F.size(answers).alias("_a"), chars.alias("_c"))
    return out.groupBy("modality").agg(F.count(F.lit(1)).alias("n"), F.sum("_t").alias("turns"), F.sum("_a").alias("answers"), F.try_divide(F.sum("_c"), F.sum("_a")).alias("mean_answer_chars"))


def nested_counts(entries: DataFrame, entry_keys: list[str], questions: str, kind: str, labels: str) -> DataFrame:
    """(counter, key, value, n) of entries with an array of question structs: entries by each of ``entry_keys``, questions by kind, by kind and each entry key, labels, and labels by kind.

    One pass: every entry lists what it counts for, and one shuffle adds it up. A null entry key counts as '?'; null kinds and labels are left out. ``key`` is null for plain counters.
    """
    none = F.lit(None).cast("string")
    item = lambda counter, key, value: F.struct(F.lit(counter).alias("counter"), key.alias("key"), value.alias("value"))
    named = {k: F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in entry_keys}
    own = F.array(*[item(k, none, v) for k, v in named.items()])
    per_question = F.flatten(F.transform(F.coalesce(F.col(questions), F.array().cast(entries.schema[questions].dataType)), lambda q: F.concat(
        F.array(item(kind, none, q[kind]), *[item(f"{kind}_{k}", q[kind], v) for k, v in named.items()]),
        F.flatten(F.transform(F.coalesce(q[labels], F.array().cast("array<string>")), lambda x: F.array(item(labels, none, x), item(f"{kind}_{labels}", q[kind], x)))),
    )))
    rows = entries.select(F.explode(F.concat(own, per_question)).alias("_i")).select("_i.*")
    rows = rows.where(F.col("value").isNotNull() & (F.col("key").isNotNull() | ~F.startswith("counter", F.lit(f"{kind}_"))))
    return rows.groupBy("counter", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def multiview_stats(records: DataFrame, scene: str, questions: str, kind: str) -> DataFrame:
    """(metric, value, v) of records with an array of question structs: records, questions, scenes, questions by kind ('unknown' for none), and the mean questions of a record (0 without records)."""
    n = F.size(F.coalesce(F.col(questions), F.array().cast(records.schema[questions].dataType))).cast("bigint")
    none = F.lit(None).cast("string")
    whole = records.agg(F.count(F.lit(1)).cast("double").alias("records"), F.coalesce(F.sum(n), F.lit(0)).cast("double").alias("questions"), F.count_distinct(scene).cast("double").alias("scenes"), F.coalesce(F.avg(n), F.lit(0.0)).alias("questions_per_record"))
    out = whole.unpivot([], ["records", "questions", "scenes", "questions_per_record"], "metric", "v").select("metric", none.alias("value"), "v")
    kinds = records.select(F.explode(questions).alias("_q")).groupBy(F.coalesce(F.col(f"_q.{kind}"), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return out.unionByName(kinds.select(F.lit("questions_of_kind").alias("metric"), "value", "v"))
