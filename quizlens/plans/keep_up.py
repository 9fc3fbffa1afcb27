"""A report that is kept up to date: only files that are new or changed are read.

A ledger holds the counts of every file, under its address, size and time. Counts of
files add up, so a report is a sum over the files that are there now: what a file
held before it was replaced, or that it was removed, needs no subtraction, as its
entry no longer belongs to a file that is listed.

An update is one append. Each of its files has a marker, and counts stand only with
the marker of their run; an update that ends half way leaves nothing that counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quizlens.operators.grading import enrich
from quizlens.operators.metrics import MODEL_KEYS, PICTURE_KEYS, outcome_cubes
from quizlens.session import stored
from quizlens.sources.graded import FILE_KEYS, LANGS, graded_files, read_graded

KEYS = list(FILE_KEYS)
LABELS = list(dict.fromkeys(MODEL_KEYS + PICTURE_KEYS))
LEDGER = ", ".join(["run string", "file string", "file_size bigint", "file_time timestamp",
                    "cube string", *[f"{label} string" for label in LABELS], "answers bigint"])
MARKER = "file"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def counted_files(spark: SparkSession, ledger: str) -> DataFrame:
    """The files that the ledger holds, each with the one run whose counts stand."""
    return read_ledger(spark, ledger).where(F.col("cube") == MARKER).groupBy(*KEYS).agg(
        F.min("run").alias("run"))


def update(spark: SparkSession, folder: str, ledger: str, langs: Sequence[str] = LANGS,
           enriched: Callable[[DataFrame], DataFrame] = enrich) -> list[str]:
    """Count the files of ``folder`` that the ledger lacks; returns their addresses.

    ``enriched`` adds the columns that the counts are by. The driver holds the addresses
    of new files, as Spark's own index of the files to read does.
    """
    run = uuid.uuid4().hex
    new = stored(graded_files(spark, folder, langs).join(
        counted_files(spark, ledger).select(*KEYS), KEYS, "left_anti"), "new-files")
    # Addresses are written as in a web address; a path to read is not.
    paths = [r.file for r in new.select("file").orderBy("file").collect()]
    if not paths:
        return []
    rows = enriched(read_graded(spark, [_literal(p) for p in paths], langs, file_keys=True))
    counts = outcome_cubes(rows, KEYS)
    marked = new.withColumn("cube", F.lit(MARKER))
    entries = counts.unionByName(marked, allowMissingColumns=True).withColumn("run", F.lit(run))
    names = [part.split()[0] for part in LEDGER.split(", ")]
    entries.select(*names).write.mode("append").parquet(ledger)
    return paths


def _literal(address: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(address))


def current_cubes(spark: SparkSession, folder: str, ledger: str,
                  langs: Sequence[str] = LANGS) -> DataFrame:
    """The counts of all files that are in ``folder`` now, as ``metrics.outcome_cubes``
    of all their rows; ``analyse.tables_of`` makes the report of them.

    Files that are not in the ledger yet do not count: call :func:`update` first.
    """
    here = graded_files(spark, folder, langs).join(counted_files(spark, ledger), KEYS)
    counts = read_ledger(spark, ledger).where(F.col("cube") != MARKER)
    return counts.join(here, [*KEYS, "run"], "left_semi").groupBy("cube", *LABELS).agg(
        F.sum("answers").alias("answers"))
