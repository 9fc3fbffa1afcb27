"""Graded answers: which rows to keep and the columns the metrics read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from quizlens.functions import outcomes as O
from quizlens.values import DISPLAY_NAMES


def exclude_paths(data: DataFrame, paths: Sequence[str] = (), column: str = "path") -> DataFrame:
    """Drop the rows of these paths. By default no path is dropped."""
    if not paths:
        return data
    return data.where(~F.coalesce(F.col(column).isin(*paths), F.lit(False)))


def add_flags(data: DataFrame) -> DataFrame:
    """Add the three correctness flags."""
    first, second, city = F.col("subject_1"), F.col("subject_2"), F.col("city_1")
    return data.withColumns({
        "subject_ok": O.is_ok(first),
        "city_ok": O.is_ok(city),
        "subject_ok_2q": O.is_ok_in_two(first, second),
    })


def not_ok_rows(data: DataFrame, outcome: str = "subject_1") -> DataFrame:
    """Rows whose outcome is anything but OK, null included."""
    return data.where(O.not_ok(F.col(outcome)))


def enrich(graded: DataFrame, names: Mapping[str, str] = DISPLAY_NAMES, strict: bool = True,
           excluded: Sequence[str] = ()) -> DataFrame:
    """Graded rows with display name, flags and picture key."""
    kept = exclude_paths(graded, excluded)
    return add_flags(kept).withColumns({
        "algorithm": O.display_name(O.without_lang(F.col("model")), names, strict),
        "picture": O.picture_key(F.col("city"), F.col("subject")),
    })
