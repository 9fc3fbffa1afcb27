"""Combine: graded files of all models into one file per language, and an audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quizlens.operators.audit import label_domains, null_counts
from quizlens.sources.graded import LANGS, read_graded
from quizlens.sources.tables import write_combined


def combine(spark: SparkSession, folder: str, out: str, langs: Sequence[str] = LANGS) -> None:
    """Write ``all_outputs_{lang}.csv`` for each language."""
    for lang in langs:
        write_combined(read_graded(spark, folder, [lang]), f"{out}/all_outputs_{lang}.csv")


def audit(graded: DataFrame) -> dict[str, DataFrame]:
    """Label values and missing labels per language, straight from the scan."""
    return {
        "label_domains": label_domains(graded, by=["lang"]),
        "null_counts": null_counts(graded, by=["lang"]),
        "null_rows": graded.where(
            F.col("city_1").isNull() | F.col("subject_1").isNull() | F.col("description_1").isNull()),
    }
