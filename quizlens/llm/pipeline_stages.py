"""The stages of the corpus pipeline: documents in, the documents that stay out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quizlens.llm import chosen_path, mixing, tiling, token_files, toxicity
from quizlens.llm.windows import NO_ID, free_names
from quizlens.session import new_path, stored


def clean_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the stage's own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, = free_names(docs, "_score")
    scored = toxicity.with_score(docs, toxicity.train(docs, labels), score)
    return scored.where(F.col(score) < 0.5).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all that have no words.

    Of rows that are equal in doc_id and text, one stays.
    """
    found = chosen_path.near_duplicates(docs)
    d, t = free_names(docs, "_d", "_t")
    kept = stored(found.where(
        F.col("doc_id").eqNullSafe(F.col("component_id"))
        & (F.col("text_key") == F.col("component_text_key"))).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias(d), F.col("text_key").alias(t)).distinct(),
        "stage-kept")
    marked = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                               t: F.xxhash64(clean_text())})
    rows = marked.join(kept, [d, t], "left_semi")
    repeated = stored(rows.groupBy(d, t).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(d, t),
                      "stage-repeated")
    once = rows.join(repeated, [d, t], "left_anti")
    again = rows.join(repeated, [d, t], "left_semi").dropDuplicates([d, t])
    return once.unionByName(again).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's budget takes it."""
    return mixing.draw(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents written as token files, and a digest of what the files hold."""
    return token_files.read_tokens(
        token_files.write_tokens(docs, new_path(spark, "pipeline-tokens")), digest=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]
