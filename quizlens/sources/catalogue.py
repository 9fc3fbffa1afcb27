"""The subject catalogue: ``;`` separated, with header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quizlens import schemas
from quizlens.values import SOURCES


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as stored; blanks at the ends of cells are kept."""
    return (
        spark.read.schema(schemas.CATALOGUE)
        .option("sep", ";").option("header", True).option("enforceSchema", False)
        .csv(path)
    )


def source_flags(catalogue: DataFrame) -> DataFrame:
    """The ``x`` marks as booleans: which sources have a picture."""
    return catalogue.withColumns(
        {source: F.col(source).eqNullSafe(F.lit("x")) for source in SOURCES}
    )
