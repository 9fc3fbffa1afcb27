"""A corpus pipeline of five stages over the documents table."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import quizlens
from quizlens.llm.pipeline_stages import STAGES
from quizlens.session import new_path

# Tasks get the package's functions with them; workers need not have it installed.
cloudpickle.register_pickle_by_value(quizlens)

#: Chosen paths and a trained classifier have no SQL; tests hold each stage
#: against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
