"""Answers: lines of seven fields with ``|`` between them and no quoting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quizlens import schemas
from quizlens.functions.text import record_line
from quizlens.sources.once import append_once

_FIELDS = schemas.ANSWERS.names


def read_answers(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Answer lines as columns, each field exactly as written.

    The lines have no quoting, so they are split and not parsed as CSV; quotes,
    backslashes and blanks stay as they are. A line with another number of
    fields raises, or gives nulls when not strict. ``model`` and ``lang`` come
    from the folders that :func:`append_answer_lines` makes; in other files they
    are null.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    folders = {name: F.col(name).cast("string") if name in lines.columns
               else F.lit(None).cast("string") for name in ("model", "lang")}
    fields = F.split("value", "[|]", -1)
    if strict:
        wrong = F.concat(F.lit(f"expected {len(_FIELDS)} fields: "), F.col("value"))
        fields = F.when(F.size(fields) == len(_FIELDS), fields).otherwise(
            F.raise_error(wrong).cast("array<string>"))
    else:
        fields = F.when(F.size(fields) == len(_FIELDS), fields)
    return lines.select(fields.alias("f"), *[c.alias(n) for n, c in folders.items()]).select(
        *[F.get("f", F.lit(i)).alias(name) for i, name in enumerate(_FIELDS)], *folders
    )


def unsafe_field() -> Column:
    """Why an answer cannot be read back from a line; null if it can."""
    joined = F.concat_ws("", *[F.col(name) for name in _FIELDS])
    return F.when(F.contains(joined, F.lit("|")), "separator").when(
        F.contains(joined, F.lit("\n")), "newline")


def answer_lines(answers: DataFrame, strict: bool = True) -> DataFrame:
    """One ``value`` per answer, ready for the text writer.

    Strict raises when a field holds a separator or a newline, as the line could
    not be read back.
    """
    line = record_line(*[F.col(name) for name in _FIELDS])
    if strict:
        line = F.when(unsafe_field().isNotNull(), F.raise_error(F.concat(
            F.lit("separator or newline in answer: "), line)).cast("string")).otherwise(line)
    folders = [name for name in ("model", "lang") if name in answers.columns]
    return answers.select(line.alias("value"), *folders)


def append_answer_lines(answers: DataFrame, path: str, strict: bool = True,
                        side: str | None = None, run: str | None = None) -> None:
    """Append answers in the line format, in a folder per model and language if the
    answers have those columns. A second run adds them again.

    With ``side`` answers that no line can hold are appended there as Parquet,
    with their ``reason``, and the others as lines: none is dropped. Each answer is
    computed once and lands in exactly one of both. With ``run`` as well, the answers
    of a run that was appended before are not added again.
    """
    if side is None:
        if run is not None:
            raise ValueError("a run needs a side table")
        lines = answer_lines(answers, strict)
        lines.write.mode("append").partitionBy(*[c for c in lines.columns if c != "value"]).option(
            "lineSep", "\n").text(path)
        return
    rows = answers.withColumns({"_line": record_line(*[F.col(n) for n in _FIELDS]),
                                "_reason": unsafe_field()})
    append_once(rows, "_line", "_reason", path, side, run or uuid.uuid4().hex,
                [name for name in ("model", "lang") if name in answers.columns])


def append_answers(answers: DataFrame, path: str) -> None:
    """Append answers as Parquet, in one folder per model and language."""
    answers.write.mode("append").partitionBy("model", "lang").parquet(path)
