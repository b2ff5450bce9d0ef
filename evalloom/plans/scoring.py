"""Queries on accuracy and dispersion: breakdowns, dialects, parsing, constraints, baselines, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import metrics, parse
from evalloom.operators import baseline, breakdown, constraints, consistency
from evalloom.operators.windows import top_k
from evalloom.plans.tables import cape_sql, mra_sql, numeric_answer_sql, r, table

AXES = {"overall": [], "flag": ["l_returnflag"], "status": ["l_linestatus"], "brand": ["p_brand"], "flag_status": ["l_returnflag", "l_linestatus"]}
LINES_SQL = "SELECT l_partkey, l_returnflag, l_linestatus, p_brand, l_extendedprice / l_quantity AS pred, p_retailprice AS target FROM lineitem JOIN part ON l_partkey = p_partkey"


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A prediction (unit price paid) and a target (list price) for each line."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.col("p_retailprice").alias("target"))
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", F.try_divide("l_extendedprice", "l_quantity").alias("pred"))
    return lines.join(part, "l_partkey")


def score_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_lines(spark, folder)
    p, t = F.col("pred"), F.col("target")
    out = breakdown.score_breakdown(rows, AXES, "l_partkey", "pred", {"mra": metrics.scored("mra", p, t), "cape": metrics.scored("cape", p, t)})
    return out.select("axis", "value", "n", r("mra"), r("cape"), "n_groups", r("mean_cv")).toDF("axis", "value", "n", "mra", "cape", "n_groups", "mean_cv")


def _breakdown_sql() -> str:
    parts = []
    for axis, cols in AXES.items():
        value = " || '_x_' || ".join(cols) if cols else "'all'"
        parts.append(f"SELECT '{axis}' AS axis, {value} AS value, l_partkey, pred, target FROM base")
    return f"""
        WITH base AS ({LINES_SQL}), sliced AS ({" UNION ALL ".join(parts)}),
        groups AS (
            SELECT axis, value, l_partkey, CASE WHEN count(pred) >= 2 AND count(pred) = count(*) THEN
                CASE WHEN min(pred) = 0 AND max(pred) = 0 THEN 0.0 WHEN avg(pred) > 0 THEN stddev_samp(pred) / avg(pred) END END AS cv
            FROM sliced GROUP BY axis, value, l_partkey
        ), level2 AS (SELECT axis, value, count(cv) AS n_groups, round(avg(cv), 6) AS mean_cv FROM groups GROUP BY axis, value)
        SELECT axis, value, count(*) AS n, round(avg(coalesce({mra_sql("pred", "target")}, 0)), 6) AS mra, round(avg(coalesce({cape_sql("pred", "target")}, 1)), 6) AS cape,
            any_value(n_groups) AS n_groups, any_value(mean_cv) AS mean_cv
        FROM sliced JOIN level2 USING (axis, value) GROUP BY axis, value
    """


#: Values with zeros, negatives, nulls and NaN, built from account balances, in groups of nation and segment.
def _dirty_values(spark: SparkSession, folder: str) -> DataFrame:
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    value = F.when(k % 97 == 0, None).when(k % 89 == 0, float("nan")).when(F.col("c_nationkey") == 3, 0.0).when(F.col("c_nationkey") == 4, -F.abs(b)).otherwise(b)
    return table(spark, folder, "customer").select("c_nationkey", "c_mktsegment", value.alias("value"))


DIRTY_SQL = """
    SELECT c_nationkey, c_mktsegment, CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN 'nan'::DOUBLE WHEN c_nationkey = 3 THEN 0.0
        WHEN c_nationkey = 4 THEN -abs(c_acctbal) ELSE c_acctbal END AS value FROM customer
"""


def _cv(dialect: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = consistency.group_cv(_dirty_values(spark, folder), ["c_nationkey", "c_mktsegment"], "value", dialect)
        return out.withColumn("cv", r("cv"))

    d = consistency.DIALECTS[dialect]
    zero = "0.0" if d.zero_const else "NULL"
    tail = "WHEN avg(v) <> 0 THEN stddev_samp(v) / avg(v)" if d.allow_negative else "WHEN avg(v) > 0 THEN stddev_samp(v) / avg(v)"
    enough = "count(v) >= 2" + (" AND count(v) = count(*)" if d.drop_incomplete else "")
    sql = f"""
        SELECT c_nationkey, c_mktsegment, count(*) AS rows, count(v) AS parsed,
            round(CASE WHEN {enough} THEN CASE WHEN min(v) = 0 AND max(v) = 0 THEN {zero} {tail} END END, 6) AS cv
        FROM (SELECT *, CASE WHEN NOT isnan(value) THEN value END AS v FROM ({DIRTY_SQL})) GROUP BY c_nationkey, c_mktsegment
    """
    return run, sql


def consistency_score(spark: SparkSession, folder: str) -> DataFrame:
    cv = consistency.group_cv(table(spark, folder, "events"), ["event_type", "user_id"], "value", "combined")
    out = consistency.mean_group_cv(cv, ["event_type"])
    return out.select("event_type", "n_groups", r("mean_cv").alias("mean_cv"), r("consistency").alias("consistency"))


CONSISTENCY_SQL = """
    SELECT event_type, count(cv) AS n_groups, round(avg(cv), 6) AS mean_cv, round(1 - exp(-avg(cv)), 6) AS consistency FROM (
        SELECT event_type, user_id, CASE WHEN count(value) >= 2 THEN CASE WHEN min(value) = 0 AND max(value) = 0 THEN 0.0 WHEN avg(value) > 0 THEN stddev_samp(value) / avg(value) END END AS cv
        FROM events GROUP BY event_type, user_id) GROUP BY event_type
"""


def completeness(spark: SparkSession, folder: str) -> DataFrame:
    out = consistency.completeness(_dirty_values(spark, folder), ["c_mktsegment"], "c_nationkey", F.col("value").isNotNull() & ~F.isnan("value"))
    return out.select("c_mktsegment", "n", r("parse_rate").alias("parse_rate"), "n_groups", r("complete_rate").alias("complete_rate"))


COMPLETENESS_SQL = f"""
    SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n, round(sum(good) / sum(n), 6) AS parse_rate, count(*) AS n_groups, round(avg(CASE WHEN n = good THEN 1.0 ELSE 0.0 END), 6) AS complete_rate FROM (
        SELECT c_mktsegment, c_nationkey, count(*) AS n, count(*) FILTER (WHERE value IS NOT NULL AND NOT isnan(value)) AS good FROM ({DIRTY_SQL}) GROUP BY 1, 2) GROUP BY 1
"""


def repeat_variance(spark: SparkSession, folder: str) -> DataFrame:
    out = consistency.repeat_variance(table(spark, folder, "lineitem"), ["l_returnflag"], ["l_suppkey", "l_partkey"], "l_quantity")
    return out.select("l_returnflag", "n_repeats", *[r(c).alias(c) for c in ("mean", "median", "max", "p90")])


REPEAT_SQL = """
    SELECT l_returnflag, count(*) AS n_repeats, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(v), 6) AS max, round(quantile_disc(v, 0.9), 6) AS p90 FROM (
        SELECT l_returnflag, l_suppkey, l_partkey, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3 HAVING count(l_quantity) >= 2) GROUP BY 1
"""


def group_corr(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    out = consistency.rank_correlation(customers.join(orders, "o_custkey"), ["c_nationkey"], "c_acctbal", "orders")
    return out.select("c_nationkey", "n", r("pearson").alias("pearson"), r("spearman").alias("spearman"))


CORR_SQL = """
    WITH joined AS (SELECT c_nationkey, c_acctbal AS x, n AS y FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey),
    ranked AS (
        SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY x) + (count(*) OVER (PARTITION BY c_nationkey, x) - 1) / 2.0 AS rx,
            rank() OVER (PARTITION BY c_nationkey ORDER BY y) + (count(*) OVER (PARTITION BY c_nationkey, y) - 1) / 2.0 AS ry FROM joined)
    SELECT c_nationkey, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM ranked GROUP BY 1
"""


def corr_p_values(spark: SparkSession, folder: str) -> DataFrame:
    """Correlations per nation with their p-values."""
    out = consistency.with_p_values(group_corr(spark, folder), "n", ["pearson", "spearman"])
    return out.select("c_nationkey", "n", r("p_pearson").alias("p_pearson"), r("p_spearman").alias("p_spearman"))


def parse_numeric_last(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", parse.numeric_answer(F.col("text")).alias("answer"))


def parse_first_answer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", parse.first_numeric_answer(F.col("text")).alias("answer"))


FIRST_SQL = r"""
    SELECT doc_id, round(try_cast(coalesce(nullif(regexp_extract(text, '(?i)answer\s*[''"]?\s*[:=]\s*[''"]?([-+]?[0-9]+(?:\.[0-9]+)?)', 1), ''),
        regexp_extract_all(text, '[-+]?[0-9]+(?:\.[0-9]+)?')[-1]) AS DOUBLE), 1) AS answer FROM documents
"""


def parse_answer_dict(spark: SparkSession, folder: str) -> DataFrame:
    v = F.format_string("%.2f", F.col("value"))
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(F.lit("thinking 3\n{'answer': "), v, F.lit("}"))).when(k == 1, F.concat(F.lit("so {{'answer': "), v, F.lit("}} holds"))).when(k == 2, F.concat(F.lit("I say 4.\nAnswer: "), v))
    text = text.when(k == 3, F.concat(F.lit("about 2 m, maybe "), v, F.lit(" m"))).otherwise(F.lit("no idea"))
    return table(spark, folder, "events").select("event_id", parse.numeric_answer(text).alias("answer"))


ANSWER_DICT_SQL = "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE round(value, 2) END AS answer FROM events"


def parse_choice(spark: SparkSession, folder: str) -> DataFrame:
    key, letter = F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B")
    text = F.when(key % 4 == 0, letter).when(key % 4 == 1, F.concat(F.lit("Answer: "), F.lower(letter))).when(key % 4 == 2, F.concat(F.lit("It is bigger.\n{'answer': '"), letter, F.lit("'}"))).otherwise(F.lit("this is a thing"))
    return table(spark, folder, "part").select("p_partkey", parse.choice_answer(text).alias("choice"))


CHOICE_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'A' WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS choice FROM part"


def parse_triplet(spark: SparkSession, folder: str) -> DataFrame:
    e = [F.format_string("%.3f", F.col("embedding")[i].cast("double")) for i in range(3)]
    listed = F.concat(F.lit("["), F.concat_ws(", ", *e), F.lit("]"))
    text = F.when(F.col("vec_id") % 3 == 0, listed).when(F.col("vec_id") % 3 == 1, F.concat(F.lit("sizes: {'answer': "), listed, F.lit("} as seen"))).otherwise(F.concat(F.lit("L "), e[0], F.lit(" W "), e[1], F.lit(" H "), e[2]))
    found = parse.triplet_answer(text)
    return table(spark, folder, "embeddings").select("vec_id", *[r(found[i], 3).alias(n) for i, n in enumerate(("length", "width", "height"))])


TRIPLET_SQL = "SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 3) + 0.0 AS {n}" for i, n in enumerate(("length", "width", "height"))) + " FROM embeddings"


def guarded_cast(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the events' JSON, with a few texts that only look like numbers."""
    text = F.get_json_object("props", "$.k")
    odd = F.when(F.col("event_id") % 7 == 0, F.concat(text, F.lit("f"))).when(F.col("event_id") % 7 == 1, F.concat(text, F.lit("_000"))).when(F.col("event_id") % 7 == 2, F.concat(F.lit(" "), text, F.lit(".5 "))).otherwise(text)
    value = parse.to_float(odd)
    return table(spark, folder, "events").select("event_id", value.alias("value"), parse.finite_or_null(value).alias("finite"))


GUARDED_SQL = """
    SELECT event_id, v AS value, v AS finite FROM (SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN NULL
        WHEN event_id % 7 = 2 THEN CAST(props->>'$.k' AS DOUBLE) + 0.5 ELSE CAST(props->>'$.k' AS DOUBLE) END AS v FROM events)
"""


def _three_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first three lines of each order, numbered by (line number, part, supplier) so that repeats have an order."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"))
    return top_k(lines, ["l_orderkey"], ["l_linenumber"], 3)


THREE_SQL = """
    WITH lines AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_discount) AS d FROM lineitem GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lines),
    trio AS (SELECT l_orderkey, max(q) FILTER (WHERE i = 1) AS a, max(q) FILTER (WHERE i = 2) AS b, max(q) FILTER (WHERE i = 3) AS c FROM ranked WHERE i <= 3 GROUP BY 1 HAVING count(*) = 3)
"""


def constraint_triangle(spark: SparkSession, folder: str) -> DataFrame:
    v = constraints.triplets(_three_lines(spark, folder), "l_orderkey", "position", ["q"])
    return v.select("l_orderkey", constraints.triangle_violation(F.col("q")).alias("violation"), constraints.camera_triangle_violation(F.col("q")[0], F.col("q")[1], F.col("q")[2]).alias("camera_violation"), constraints.scale_of(F.col("q")).alias("scale"))


TRIANGLE_SQL = f"""{THREE_SQL} SELECT l_orderkey, greatest(0.0, a - b - c, b - a - c, c - a - b) AS violation, greatest(0.0, abs(a - b) - c, c - a - b) AS camera_violation,
    greatest(abs(a), abs(b), abs(c), 1e-9) AS scale FROM trio"""


def ordered_triplet(spark: SparkSession, folder: str) -> DataFrame:
    v = constraints.triplets(_three_lines(spark, folder), "l_orderkey", "position", ["q"])
    return v.select("l_orderkey", constraints.strictly_falling(F.col("q")).alias("strict"), constraints.weakly_falling(F.col("q")).alias("weak"))


def constraint_report(spark: SparkSession, folder: str) -> DataFrame:
    v = constraints.triplets(_three_lines(spark, folder), "l_orderkey", "position", ["q"]).withColumn("violation", constraints.triangle_violation(F.col("q")))
    v = v.withColumn("longest", F.array_max("q") > 40)
    out = constraints.constraint_report(v, ["longest"], "violation")
    return out.select("longest", "n", *[r(c).alias(c) for c in ("mean_violation", "p95_violation", "pass_0p11", "pass_0p22")])


CONSTRAINT_SQL = f"""{THREE_SQL} SELECT longest, count(*) AS n, round(avg(v), 6) AS mean_violation, round(quantile_cont(v, 0.95), 6) AS p95_violation,
    round(avg(CASE WHEN v <= 0.11 THEN 1.0 ELSE 0.0 END), 6) AS pass_0p11, round(avg(CASE WHEN v <= 0.22 THEN 1.0 ELSE 0.0 END), 6) AS pass_0p22
    FROM (SELECT greatest(0.0, a - b - c, b - a - c, c - a - b) AS v, greatest(a, b, c) > 40 AS longest FROM trio) GROUP BY 1"""


def choice_transitivity(spark: SparkSession, folder: str) -> DataFrame:
    lines = _three_lines(spark, folder).withColumn("pred", F.when(F.col("q") > 25, "A").when(F.col("q") > 3, "B").otherwise("?")).withColumn("truth", F.when(F.col("q") > 20, "A").otherwise("B"))
    v = constraints.triplets(lines, "l_orderkey", "position", ["pred", "truth"])
    return v.select("l_orderkey", constraints.transitive_choices(F.col("pred"), F.col("truth")).alias("right"))


CHOICES_SQL = f"""{THREE_SQL} SELECT l_orderkey, CASE WHEN least(a, b, c) > 3 THEN NOT ((a > 20 AND a <= 25) OR (b > 20 AND b <= 25) OR (c > 20 AND c <= 25)) END AS "right" FROM trio"""


def chance_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The constant that answers the distances and sizes of the clips best, by question type; truths with their units and decimal commas."""
    clips = table(spark, folder, "clips").select("question_type", parse.length_metres(F.col("ground_truth")).alias("target"))
    out = baseline.best_constant(clips, ["question_type"], "target")
    return out.select("question_type", r("constant", 9).alias("constant"), r("mean_mra").alias("mean_mra"), "n")


_LENGTH = "'^\\s*~?\\s*([-+]?[0-9]+(?:[.,][0-9]+)?)\\s*(mm|cm|m|met(?:re|er)s?)?\\s*$'"
CHANCE_SQL = f"""
    WITH g AS (SELECT question_type, try_cast(replace(regexp_extract(lower(ground_truth), {_LENGTH}, 1), ',', '.') AS DOUBLE)
        / CASE regexp_extract(lower(ground_truth), {_LENGTH}, 2) WHEN 'mm' THEN 1000 WHEN 'cm' THEN 100 ELSE 1 END AS t FROM clips),
    t AS (SELECT question_type, t, count(*) AS n FROM g WHERE t IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT unnest([1.0, {", ".join(repr(x) for x in metrics.CANDIDATE_FACTORS)}, {", ".join(repr(2 - x) for x in metrics.CANDIDATE_FACTORS)}]::DOUBLE[]) AS f),
    c AS (SELECT DISTINCT question_type, t * f AS c FROM t, f),
    s AS (SELECT question_type, c, round(sum(n * {mra_sql("c", "t")}) / sum(n), 9) AS m, CAST(sum(n) AS BIGINT) AS n FROM c JOIN t USING (question_type) GROUP BY 1, 2)
    SELECT question_type, round(c, 9) AS constant, round(m, 6) AS mean_mra, n FROM s QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY m DESC, c) = 1
"""


def _region_summaries(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    each = customers.groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("c_acctbal").alias("balance")).join(nations, "c_nationkey")
    return breakdown.long_metrics(each.withColumn("w", F.col("n")), ["n_regionkey", "w"], ["n", "balance"])


def weighted_merge(spark: SparkSession, folder: str) -> DataFrame:
    out = breakdown.weighted_merge(_region_summaries(spark, folder), ["n_regionkey"], "metric", "v", "w", ["n"])
    return out.select("n_regionkey", "metric", r("v", 4).alias("v"))


MERGE_SQL = """
    WITH c AS (SELECT n_regionkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_regionkey, 'n' AS metric, CAST(count(*) AS DOUBLE) AS v FROM c GROUP BY 1 UNION ALL SELECT n_regionkey, 'balance', round(avg(c_acctbal), 4) FROM c GROUP BY 1
"""


def _nation_scores(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("score")).join(nations, "c_nationkey").select("n_name", "c_mktsegment", "score")


SCORES_SQL = "SELECT n_name, c_mktsegment, round(avg(c_acctbal), 4) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"


def rank_models(spark: SparkSession, folder: str) -> DataFrame:
    return breakdown.ranked(_nation_scores(spark, folder), "score", "n_name", ["c_mktsegment"]).withColumn("rank", F.col("rank").cast("bigint"))


def best_per_column(spark: SparkSession, folder: str) -> DataFrame:
    return breakdown.best_flags(_nation_scores(spark, folder), "c_mktsegment", "score", F.col("c_mktsegment") != "BUILDING")


def row_averages(spark: SparkSession, folder: str) -> DataFrame:
    """Mean values of each user's events by type, side by side, with their average and whether a type is missing."""
    kinds = ["click", "view", "purchase"]
    each = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("score"))
    wide = breakdown.pivot_table(each, ["user_id"], "event_type", kinds, F.first("score"))
    mean, partial = breakdown.row_average(kinds)
    return wide.select("user_id", r(mean).alias("mean"), partial.alias("partial"))


ROWAVG_SQL = """
    WITH s AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'view') AS b, avg(value) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY 1)
    SELECT user_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS mean, a IS NULL OR b IS NULL OR c IS NULL AS partial FROM s
"""


def flat_metric_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Flat metric keys such as 'qtype:size_n_groups' read back into their parts."""
    groups = table(spark, folder, "consistency_groups").select("question_type", "engine").distinct()
    names = F.explode(F.array(*[F.lit(x) for x in ("n", "n_groups", "mean_CV", "MRA")]))
    keys = groups.select(F.concat(F.lit("qtype:"), "question_type").alias("k")).union(groups.select(F.concat(F.lit("engine:"), "engine"))).distinct().select(F.col("k"), names.alias("m"))
    part = breakdown.flat_metric_parts(F.concat_ws("_", "k", "m"))
    return keys.select(F.concat_ws("_", "k", "m").alias("key"), part["axis"].alias("axis"), part["value"].alias("value"), part["metric"].alias("metric"))


FLAT_SQL = """
    WITH k AS (SELECT DISTINCT 'qtype' AS axis, question_type AS value FROM consistency_groups UNION SELECT DISTINCT 'engine', engine FROM consistency_groups)
    SELECT axis || ':' || value || '_' || m AS key, axis, value, m AS metric FROM k, (SELECT unnest(['n', 'n_groups', 'mean_CV', 'MRA']) AS m)
"""


def error_bands(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_lines(spark, folder)
    return rows.groupBy(metrics.error_band(metrics.relative_error(F.col("pred"), F.col("target"))).alias("band")).agg(F.count(F.lit(1)).alias("n"))


BANDS_SQL = f"SELECT CASE WHEN e IS NULL THEN 'none' WHEN e <= 0.25 THEN 'good' WHEN e <= 0.5 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM (SELECT abs((pred - target) / target) AS e FROM ({LINES_SQL})) GROUP BY 1"


def catalog() -> dict:
    return {
        "score_breakdown": (score_breakdown, _breakdown_sql()),
        **{f"cv_{d}": _cv(d) for d in consistency.DIALECTS},
        "consistency_score": (consistency_score, CONSISTENCY_SQL),
        "completeness": (completeness, COMPLETENESS_SQL),
        "repeat_variance": (repeat_variance, REPEAT_SQL),
        "group_corr": (group_corr, CORR_SQL),
        "corr_p_values": (corr_p_values, None),
        "parse_numeric_last": (parse_numeric_last, f"SELECT doc_id, {numeric_answer_sql('text')} AS answer FROM documents"),
        "parse_first_answer": (parse_first_answer, FIRST_SQL),
        "parse_answer_dict": (parse_answer_dict, ANSWER_DICT_SQL),
        "parse_choice": (parse_choice, CHOICE_SQL),
        "parse_triplet": (parse_triplet, TRIPLET_SQL),
        "guarded_cast": (guarded_cast, GUARDED_SQL),
        "constraint_triangle": (constraint_triangle, TRIANGLE_SQL),
        "ordered_triplet": (ordered_triplet, f'{THREE_SQL} SELECT l_orderkey, a > b AND b > c AS strict, a >= b AND b >= c AS weak FROM trio'),
        "constraint_report": (constraint_report, CONSTRAINT_SQL),
        "choice_transitivity": (choice_transitivity, CHOICES_SQL),
        "chance_baseline": (chance_baseline, CHANCE_SQL),
        "weighted_merge": (weighted_merge, MERGE_SQL),
        "rank_models": (rank_models, f"SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY score DESC NULLS LAST, n_name) AS rank FROM ({SCORES_SQL})"),
        "best_per_column": (best_per_column, f"SELECT *, coalesce(score = CASE WHEN c_mktsegment <> 'BUILDING' THEN max(score) OVER (PARTITION BY c_mktsegment) ELSE min(score) OVER (PARTITION BY c_mktsegment) END, false) AS best FROM ({SCORES_SQL})"),
        "row_averages": (row_averages, ROWAVG_SQL),
        "flat_metric_keys": (flat_metric_keys, FLAT_SQL),
        "error_bands": (error_bands, BANDS_SQL),
    }
