"""Batch answering with a pluggable responder, and answer rows.

A responder takes a batch of requests and returns one answer per row: its text,
or a pair of the text and the length of the request as the model saw it. Models
that repeat the request before the answer need that length, which only the
responder knows. The maker that builds a responder runs once per worker process;
tasks and both turns share what it made.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quizlens import schemas
from quizlens.functions.cleaning import clean_by_model
from quizlens.functions.text import record_line
from quizlens.operators.requests import ask_first, ask_second
from quizlens.session import stored
from quizlens.values import POLICIES, RENDERED_PREFIX_EXCESS, ModelPolicy

Responder = Callable[[pd.DataFrame], Sequence[str | tuple[str, int]]]
REQUEST_COLUMNS = ("dialogue", "path", "uri", "model", "max_new_tokens", "decoding")


def responder_of(run: str, make_responder: Callable[[], Responder]) -> Responder:
    """This process's responder of a run; making the next run's lets go of it.

    It is kept in a module of its own, as the functions of a task are not kept.
    """
    kept = sys.modules.setdefault("_kept_responder", types.ModuleType("_kept_responder"))
    if getattr(kept, "run", None) != run:
        kept.run = kept.responder = None
        kept.responder = make_responder()
        kept.run = run
    return kept.responder


def answer_batches(requests: DataFrame, make_responder: Callable[[], Responder], column: str,
                   inputs: Sequence[str] = REQUEST_COLUMNS, run: str | None = None) -> DataFrame:
    """Add ``column``, the responder's answer to each row, and ``rendered_length``,
    null where the responder does not give it.

    Calls with the same ``run`` share one responder in each worker process.

    This is the only place where rows go to Python, in Arrow batches. Only those
    ``inputs`` that are present travel; the other columns wait in the JVM, which an
    operator over whole rows would send there and back. The column is marked as not
    deterministic, so that the optimizer never asks a model twice for one answer.
    """
    run = run or uuid.uuid4().hex

    @F.pandas_udf("text string, rendered_length int")
    def respond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = responder_of(run, make_responder)
        for batch in batches:
            answers = [a if isinstance(a, tuple) else (a, None) for a in responder(batch)]
            yield pd.DataFrame({
                "text": pd.Series([a[0] for a in answers], dtype=object),
                "rendered_length": pd.Series([a[1] for a in answers], dtype="Int32")})

    request = F.struct(*[F.col(name) for name in inputs if name in requests.columns])
    return requests.withColumn("_answer", respond.asNondeterministic()(request)).withColumns({
        column: F.col("_answer.text"), "rendered_length": F.col("_answer.rendered_length"),
    }).drop("_answer")


def answer_two_questions(requests: DataFrame, make_responder: Callable[[], Responder],
                         policies: Sequence[ModelPolicy] = POLICIES,
                         store: bool = True) -> DataFrame:
    """Ask the first question of every row, then the second, and clean both answers.

    ``requests`` comes from ``pair_requests`` and ``add_policy``. For a model
    whose recipe cuts off the repeated request, a responder that does not give
    the length of that request raises.

    ``store`` keeps the first answers in the shared folder before they are used.
    A responder that samples would otherwise give another answer when a lost
    task runs again, and the history would not match the stored answer.
    """
    run = uuid.uuid4().hex
    cols = {c: F.col(c) for c in ("question_1", "question_2", "rendered_length")}
    model = F.col("model")

    first = answer_batches(
        ask_first(requests).withColumn("dialogue", F.col("dialogue_1")).drop("dialogue_1"),
        make_responder, "raw_1", run=run).drop("dialogue")
    first = stored(first, "first-answers") if store else first
    first = first.withColumn(
        "answer_1", clean_by_model(F.col("raw_1"), model, {p.model: p.clean_1 for p in policies}, cols)
    ).drop("rendered_length")
    first = first.withColumn(
        "remembered", F.when(F.col("raw_history"), F.col("raw_1")).otherwise(F.col("answer_1")))

    second = ask_second(first, answer="remembered")
    second = answer_batches(
        second.withColumn("dialogue", F.col("dialogue_2")).drop("dialogue_2", "remembered", "raw_1"),
        make_responder, "raw_2", run=run)
    return second.drop("dialogue").withColumn(
        "answer_2", clean_by_model(F.col("raw_2"), model, {p.model: p.clean_2 for p in policies}, cols)
    ).drop("raw_2", "rendered_length")


def answer_rows(answered: DataFrame) -> DataFrame:
    """The seven answer fields, all text, and the line they make.

    The id is written as it stands in the file name (``id_text``), such as ``01``.
    """
    fields = [F.col("id_text" if name == "id" and "id_text" in answered.columns else name)
              .cast("string").alias(name) for name in schemas.ANSWERS.names]
    return answered.select(*fields).withColumn(
        "line", record_line(*[F.col(name) for name in schemas.ANSWERS.names]))


def two_turn_pairs(turns: DataFrame) -> DataFrame:
    """The first two questions and answers of each dialogue, side by side.

    Only the first two rows per dialogue and role can be read, so Spark applies
    that limit in every task before the shuffle; a very long dialogue is never
    gathered in one place.
    """
    spoken = turns.where(F.col("role").isin("user", "assistant"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    leading = spoken.withColumn("nth", nth).where(F.col("nth") <= 2)

    def pick(role: str, number: int):
        return F.min(F.when((F.col("role") == role) & (F.col("nth") == number), F.col("text")))

    return leading.groupBy("conv_id").agg(
        pick("user", 1).alias("question_1"), pick("assistant", 1).alias("answer_1"),
        pick("user", 2).alias("question_2"), pick("assistant", 2).alias("answer_2"),
    )


def make_plain_responder() -> Responder:
    """A responder for tests: it repeats the question and states what it was given.

    The length it gives for the request depends on the answers it was told.
    """

    def respond(batch):
        answers = []
        for turns in batch["dialogue"]:
            parts = [(turn["role"], part) for turn in turns for part in turn["content"]]
            asked = [p["text"] for role, p in parts if role == "user" and p["type"] == "text"]
            told = [p["text"] for role, p in parts if role == "assistant"]
            heard = sum(map(len, told))
            answers.append((
                f"{asked[-1]} turns {len(turns)};  parts {len(parts)};\n"
                f"told {heard}<|end_of_text|>x", RENDERED_PREFIX_EXCESS + heard % 5))
        return answers

    return respond
