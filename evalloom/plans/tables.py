"""Reading the driver's tables, and SQL fragments shared by the queries' SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.metrics import MRA_THRESHOLDS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def error_sql(p: str, t: str) -> str:
    return f"(CASE WHEN {t} = 0 THEN CASE WHEN {p} = 0 THEN 0.0 WHEN {p} IS NOT NULL THEN 'inf'::DOUBLE END ELSE abs(({p} - {t}) / {t}) END)"


def mra_sql(p: str, t: str) -> str:
    return "((" + " + ".join(f"CAST({error_sql(p, t)} <= {x!r}::DOUBLE AS INT)" for x in MRA_THRESHOLDS) + ") / 10.0::DOUBLE)"


def cape_sql(p: str, t: str) -> str:
    return f"(CASE WHEN {t} = 0 THEN CASE WHEN {p} IS NOT NULL THEN 1.0 END ELSE least(1.0, abs(({p} - {t}) / {t})) END)"


# Numbers, answers and last lines of a text in DuckDB's dialect; the patterns are those of evalloom.functions.parse.
NUM = r"[-+]?[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?"


def last_line_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|\\n|\\r'), lambda q: trim(q)), lambda q: q <> '')[-1]"


def literal_sql(x: str) -> str:
    inner = f"nullif(regexp_extract(trim({x}), '(?is)^\\{{\\s*[''\"]answer[''\"]\\s*:\\s*[''\"]?([^{{}},''\"]+?)[''\"]?\\s*\\}}$', 1), '')"
    return (
        f"coalesce(try_cast(nullif(regexp_extract(trim({x}), '(?i)^(?:answer\\s*[:=]\\s*)?({NUM})\\.?$', 1), '') AS DOUBLE), "
        f"CASE WHEN regexp_full_match(trim({x}), '[-+]?\\.[0-9]+') THEN try_cast(trim({x}) AS DOUBLE) END, CASE trim({x}) WHEN 'True' THEN 1.0 WHEN 'False' THEN 0.0 END, "
        f"CASE WHEN regexp_full_match({inner}, '\\s*[-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?\\s*') THEN try_cast({inner} AS DOUBLE) END)"
    )


def numeric_answer_sql(x: str) -> str:
    double = f"regexp_extract_all({x}, '(?is)\\{{\\{{\\s*[''\"]answer[''\"]\\s*:\\s*([^{{}}]+?)\\s*\\}}\\}}', 1)[-1]"
    single = f"regexp_extract_all({x}, '(?is)\\{{\\s*[''\"]answer[''\"]\\s*:\\s*([^{{}}]+?)\\s*\\}}', 1)[-1]"
    return f"coalesce({literal_sql(last_line_sql(x))}, {literal_sql(double)}, {literal_sql(single)}, try_cast(regexp_extract_all({x}, '{NUM}')[-1] AS DOUBLE))"
