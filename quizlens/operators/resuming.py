"""Asking that can stop and go on.

A ledger keeps the raw answer to every question. Its key is the picture, the
language, the model, the number of the question and its text. A run asks only
what the ledger lacks, in rounds of bounded size, and appends each round when it
is answered: a run that is stopped loses no more than the round it was at, and a
second question follows the very first answer that the ledger holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quizlens.functions.cleaning import clean_by_model
from quizlens.operators.answering import REQUEST_COLUMNS, Responder, answer_batches
from quizlens.operators.requests import ask_first, ask_second
from quizlens.session import stored
from quizlens.values import POLICIES, ModelPolicy

KEYS = ("path", "lang", "model")
ROWS_PER_ROUND = 200_000
ROWS_PER_TASK = 2_000
FILES_PER_PART = 4
LEDGER = ("path string, lang string, model string, question_no int, question string, "
          "raw string, rendered_length int, run string")


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows. A folder that is not there is an empty ledger."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def _one_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key. Nearly all keys are of one row, so rows meet before they are
    put together, and a join by the keys finds them in place."""
    return rows.repartition(*keys).groupBy(*keys).agg(
        F.min(F.struct("run", "raw", "rendered_length")).alias("answer"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per key. A folder that is not there is an empty ledger.

    Two runs at the same time may answer a question twice; one of the answers counts,
    always the same one.
    """
    keys = [*KEYS, "question_no", "question"]
    return _one_each(ledger_rows(spark, ledger), keys).select(
        *keys, "answer.raw", "answer.rendered_length")


def answers_to(spark: SparkSession, ledger: str, number: int) -> DataFrame:
    """Keys, ``question_N``, ``raw_N`` and ``length_N`` of the answers to question N, one
    row per key as in ``read_ledger``."""
    keys = [*KEYS, f"question_{number}"]
    rows = ledger_rows(spark, ledger).where(F.col("question_no") == number)
    return _one_each(rows.withColumnRenamed("question", keys[-1]), keys).select(
        *keys, F.col("answer.raw").alias(f"raw_{number}"),
        F.col("answer.rendered_length").alias(f"length_{number}"))


def pending(requests: DataFrame, ledger: str, number: int) -> DataFrame:
    """The requests whose question N has no answer yet, one per key.

    Equal requests are asked once. Requests without a path, language or model
    equal no entry of the ledger, so they are an error.
    """
    keys = [*KEYS, f"question_{number}"]
    missing = F.raise_error(F.lit("a request needs path, lang, model and question")).cast("string")
    checked = requests.withColumns({k: F.coalesce(k, missing) for k in keys})
    known = ledger_rows(requests.sparkSession, ledger).where(F.col("question_no") == number)
    known = known.select(*KEYS, F.col("question").alias(keys[-1]))
    return checked.join(known, keys, "left_anti").dropDuplicates(keys)


def in_rounds(sizes: Mapping[int, int], rows_per_round: int) -> list[list[int]]:
    """Parts of these sizes, put together to rounds of about ``rows_per_round`` rows."""
    rounds, n = [], rows_per_round
    for part, size in sorted(sizes.items()):
        if n + size > rows_per_round:
            rounds.append([])
            n = 0
        rounds[-1].append(part)
        n += size
    return rounds


def ask_pending(todo: DataFrame, most: int, number: int, make_responder: Callable[[], Responder],
                ledger: str, run: str, rows_per_round: int = ROWS_PER_ROUND,
                rows_per_task: int = ROWS_PER_TASK) -> None:
    """Answer ``todo``, which has ``dialogue`` and at most ``most`` rows, round after round
    into the ledger.

    The rows are stored in a folder per part, so that a round reads its own rows only.
    """
    keys = [*KEYS, f"question_{number}"]
    parts = -(-most // rows_per_round) or 1
    needed = [c for c in todo.columns if c in (*keys, *REQUEST_COLUMNS)]
    place = F.xxhash64(*keys)
    todo = todo.select(*needed, F.pmod(place, F.lit(parts)).cast("int").alias("_part"),
                       F.pmod(F.shiftright(place, 32), F.lit(FILES_PER_PART)).alias("_file"))
    dealt = todo.repartition(parts * FILES_PER_PART, "_part", "_file").drop("_file")
    todo = stored(dealt, "pending", folder_by=["_part"])
    sizes = {r["_part"]: r["count"] for r in todo.groupBy("_part").count().collect()}
    cores = todo.sparkSession.sparkContext.defaultParallelism
    for asked in in_rounds(sizes, rows_per_round):
        part = todo.where(F.col("_part").isin(asked)).drop("_part")
        n = sum(sizes[p] for p in asked)
        answer_batches(part.repartition(max(cores, -(-n // rows_per_task)), *keys),
                       make_responder, "raw", run=run).select(
            *KEYS, F.lit(number).alias("question_no"),
            F.col(f"question_{number}").alias("question"), "raw", "rendered_length",
            F.lit(run).alias("run")).write.mode("append").parquet(ledger)


def answer_with_ledger(requests: DataFrame, make_responder: Callable[[], Responder], ledger: str,
                       policies: Sequence[ModelPolicy] = POLICIES,
                       rows_per_round: int = ROWS_PER_ROUND) -> DataFrame:
    """``answering.answer_two_questions`` from a ledger that is filled first.

    ``requests`` comes from ``pair_requests`` and ``add_policy`` and has ``path``.
    All rows of equal keys get the one answer.
    """
    spark, run = requests.sparkSession, uuid.uuid4().hex
    requests = stored(requests, "requests")
    most = requests.count()
    model = F.col("model")
    cols = {c: F.col(c) for c in ("question_1", "question_2")}

    first = ask_first(pending(requests, ledger, 1)).withColumnRenamed("dialogue_1", "dialogue")
    ask_pending(first, most, 1, make_responder, ledger, run, rows_per_round)

    told = requests.join(answers_to(spark, ledger, 1), [*KEYS, "question_1"]).withColumn(
        "answer_1", clean_by_model(F.col("raw_1"), model, {p.model: p.clean_1 for p in policies},
                                   {**cols, "rendered_length": F.col("length_1")}))
    told = stored(told.withColumn(
        "remembered", F.when(F.col("raw_history"), F.col("raw_1")).otherwise(F.col("answer_1"))
    ).drop("raw_1", "length_1"), "told")
    second = ask_second(pending(told, ledger, 2), answer="remembered").withColumnRenamed(
        "dialogue_2", "dialogue")
    ask_pending(second, most, 2, make_responder, ledger, run, rows_per_round)

    answered = told.join(answers_to(spark, ledger, 2), [*KEYS, "question_2"])
    return answered.withColumn("answer_2", clean_by_model(
        F.col("raw_2"), model, {p.model: p.clean_2 for p in policies},
        {**cols, "rendered_length": F.col("length_2")})).drop(
        "raw_2", "length_2", "remembered")
