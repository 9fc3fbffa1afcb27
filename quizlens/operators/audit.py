"""Data quality: which labels occur, and where they are missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quizlens.schemas import AUDITED


def label_domains(data: DataFrame, columns: Sequence[str] = AUDITED,
                  by: Sequence[str] = ()) -> DataFrame:
    """Every value of every audited column, null included, with its count.

    Labels are few, so the rows are first counted per combination of labels and
    only those counts are unpivoted; the table itself is never multiplied.
    """
    combos = data.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("rows"))
    return (
        combos.unpivot([*by, "rows"], list(columns), "column", "value")
        .groupBy(*by, "column", "value")
        .agg(F.sum("rows").cast("bigint").alias("rows"))
    )


def null_counts(data: DataFrame, columns: Sequence[str] = AUDITED,
                by: Sequence[str] = ()) -> DataFrame:
    """The number of missing labels per audited column, in one pass."""
    return data.groupBy(*by).agg(
        *[F.count_if(F.col(c).isNull()).cast("bigint").alias(f"{c}_nulls") for c in columns]
    )


def null_rows(data: DataFrame, column: str) -> DataFrame:
    """The rows where the label is missing."""
    return data.where(F.col(column).isNull())
