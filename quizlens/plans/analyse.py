"""Analyse: every table of the report from one pass over the graded answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from quizlens.operators.differences import ALL_NAMES, followup_difference, language_difference
from quizlens.operators.grading import add_flags
from quizlens.operators.metrics import (
    accuracy,
    outcome_counts,
    outcome_counts_by_language,
    outcome_cubes,
)
from quizlens.session import stored
from quizlens.sources.tables import write_table
from quizlens.values import LANG_TAGS

WEIGHT = "answers"


def report(enriched: DataFrame, names: Sequence[str] = ALL_NAMES, strict: bool = False,
           store: bool = True, tags: Mapping[str, str] = LANG_TAGS) -> dict[str, DataFrame]:
    """All result tables by name, for the languages of ``tags``.

    One pass counts the answers per model and labels, and per picture and labels.
    Both are stored, in a folder each, and all tables are sums over one of them.
    A language that has no tag raises as a combined table is read.
    """
    cubes = outcome_cubes(enriched)
    cubes = stored(cubes, "cubes", folder_by=["cube"]) if store else cubes
    return tables_of(cubes, names, strict, tags)


def tables_of(cubes: DataFrame, names: Sequence[str] = ALL_NAMES, strict: bool = False,
              tags: Mapping[str, str] = LANG_TAGS) -> dict[str, DataFrame]:
    """All result tables from the counts of ``metrics.outcome_cubes``."""
    by_model = add_flags(cubes.where("cube = 'model'"))
    by_picture = cubes.where("cube = 'picture'")
    tables = {}
    for lang in tags:
        rows, pictures = (c.where(F.col("lang") == lang) for c in (by_model, by_picture))
        tables[f"accuracy_{lang}"] = accuracy(rows, weight=WEIGHT)
        tables[f"picture_subject1_{lang}"] = outcome_counts(pictures, ["picture"], "subject_1", WEIGHT)
        tables[f"picture_city1_{lang}"] = outcome_counts(pictures, ["picture"], "city_1", WEIGHT)
        tables[f"{lang}_subject_diff"] = followup_difference(
            rows, names=names, strict=strict, weight=WEIGHT)
    for name, outcome in (("subject1", "subject_1"), ("city1", "city_1")):
        tables[f"picture_{name}_combo"] = outcome_counts_by_language(
            by_picture, outcome, weight=WEIGHT, tags=tags)
    tables["ita_eng_diff"] = language_difference(by_model, names=names, strict=strict, weight=WEIGHT)
    return tables


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Write each table as CSV with header."""
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}.csv")
