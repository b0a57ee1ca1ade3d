"""Sinks: JSON payloads, CSV tables, Markdown and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as the table has partitions."""
    df.write.mode("overwrite").json(path)


def payload(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """A run's payload as lines: the summary (one row), then each result, told apart by ``part``."""
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("body"))
    return line(summary, "summary").unionByName(line(rows, "result"))


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """``fields`` in their order, empty where ``df`` lacks one; all columns without ``fields``."""
    if fields:
        df = df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])
    df.write.mode("overwrite").option("header", True).csv(path)


def cell(c: Column, kind: str, digits: int) -> Column:
    number = F.format_string(f"%.{digits}f", c.cast("double")) if kind in ("double", "float") else c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), number), F.lit("—"))


def markdown_rows(df: DataFrame, digits: int = 3) -> DataFrame:
    """One Markdown table row (line) for each row; fractions have ``digits`` places, missing values are a dash."""
    cells = [cell(F.col(c), kind, digits) for c, kind in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(df: DataFrame) -> list[str]:
    """The header and rule lines."""
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]


def unavailable(df: DataFrame, backend: str, reason: str) -> DataFrame:
    """The one-row report of a run whose backend is not there."""
    return df.limit(1).select(F.lit(backend).alias("method"), F.lit("unavailable").alias("status"), F.lit(reason).alias("reason"), F.lit(0).alias("num_examples"))


def save_store(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def write_by_updates(episodes: DataFrame, path: str) -> None:
    """One folder for each split part and number of updates."""
    episodes.write.mode("overwrite").partitionBy("k_updates").json(path)
