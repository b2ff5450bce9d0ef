"""Writing results: plans, conversations, TSV, and Markdown or LaTeX tables of small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.reshape import conversation, merge_maps

MOST_REPORT_ROWS = 10_000


def write_plan(groups: DataFrame, clips: DataFrame, folder: str) -> None:
    groups.write.mode("overwrite").json(f"{folder}/groups")
    clips.write.mode("overwrite").json(f"{folder}/clips")


def read_plan(spark, folder: str, group_schema, clip_schema) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(group_schema).json(f"{folder}/groups"), spark.read.schema(clip_schema).json(f"{folder}/clips")


def metadata(base: Column, update: Column) -> Column:
    """Two maps; the update wins."""
    return merge_maps(base, update)


def write_conversations(df: DataFrame, question: Column, answer: Column, media: str, folder: str, kind: str = "video") -> None:
    """JSON lines {kind, conversations}."""
    df.select(F.col(media).alias(kind), conversation(question, answer, f"<{kind}>").alias("conversations")).write.mode("overwrite").json(folder)


def write_tsv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(folder)


def _cells(df: DataFrame, digits: int, missing: str) -> list[list[str]]:
    rows = df.limit(MOST_REPORT_ROWS + 1).collect()
    if len(rows) > MOST_REPORT_ROWS:
        raise ValueError("a report table must be small")
    show = lambda v: missing if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return [[show(v) for v in r] for r in rows]


def markdown(df: DataFrame, digits: int = 2, missing: str = "-") -> str:
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in _cells(df, digits, missing)]) + "\n"


def tsv(df: DataFrame, digits: int = 4) -> str:
    return "\n".join(["\t".join(df.columns), *["\t".join(r) for r in _cells(df, digits, "")]]) + "\n"


def latex(df: DataFrame, digits: int = 2, missing: str = "--") -> str:
    clean = lambda s: s.replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&").replace("#", r"\#")
    body = [" & ".join(clean(c) for c in r) + r" \\" for r in _cells(df, digits, missing)]
    head = [r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(clean(c) for c in df.columns) + r" \\ \hline"]
    return "\n".join([*head, *body, r"\end{tabular}"]) + "\n"
