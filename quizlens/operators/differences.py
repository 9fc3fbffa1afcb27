"""How many more answers of each outcome there are after than before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quizlens.functions import outcomes as O
from quizlens.operators.literals import literal_table
from quizlens.values import DISPLAY_NAMES, OUTCOMES

ALL_NAMES = tuple(DISPLAY_NAMES.values())


def outcome_difference(data: DataFrame, before: Column, after: Column,
                       names: Sequence[str] = ALL_NAMES, strict: bool = False,
                       outcomes: Sequence[str] = OUTCOMES, langs: Sequence[str] | None = None,
                       weight: str | None = None) -> DataFrame:
    """Per name, the count of each outcome in ``after`` minus that in ``before``.

    There is one row for every listed name, in the order ``display_order``, or
    one per name and language when ``langs`` is given.
    Names without rows get zeros; strict raises when a name has no label on
    either side. Outcomes that are not listed, and nulls, do not count.

    Answers are first counted per pair of labels, which leaves a few rows per
    name. The zero rows come from one extra row per name, so no join is needed.
    """
    keys = ["algorithm"] if langs is None else ["algorithm", "lang"]
    weight_col = F.lit(1) if weight is None else F.col(weight)
    wanted = F.col("algorithm").isin(*names)
    if langs is not None:
        wanted = wanted & F.col("lang").isin(*langs)
    rows = data.where(wanted).select(
        *keys, before.alias("before"), after.alias("after"),
        weight_col.cast("bigint").alias("weight"),
    )
    pairs = rows.groupBy(*keys, "before", "after").agg(F.sum("weight").alias("weight"))
    zero = literal_table(data.sparkSession, ", ".join(f"{k} string" for k in keys), [
        (name,) if langs is None else (name, lang) for name in names for lang in langs or [None]])
    pairs = pairs.unionByName(zero, allowMissingColumns=True)

    def answers(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("weight")).otherwise(F.lit(0))).cast("bigint")

    grouped = pairs.groupBy(*keys).agg(
        answers(F.col("before").isNotNull()).alias("labels_before"),
        answers(F.col("after").isNotNull()).alias("labels_after"),
        *[(answers(F.col("after") == o) - answers(F.col("before") == o)).alias(o)
          for o in outcomes],
    )
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("algorithm"))
    name = F.col("algorithm")
    if strict:
        missing = (F.col("labels_before") == 0) | (F.col("labels_after") == 0)
        name = F.when(missing, F.raise_error(F.concat(
            F.lit("no labels for: "), name)).cast("string")).otherwise(name)
    return grouped.select(name.alias("algorithm"), *keys[1:], *outcomes,
                          (order - 1).cast("int").alias("display_order"))


def frame_difference(before: DataFrame, after: DataFrame, key_before: str, key_after: str,
                     **options) -> DataFrame:
    """The difference between two frames that may come from different inputs."""
    weight = options.get("weight")
    carried = ["algorithm"] + ([weight] if weight else [])
    both = before.select(*carried, F.col(key_before).alias("before_label")).unionByName(
        after.select(*carried, F.col(key_after).alias("after_label")), allowMissingColumns=True)
    return outcome_difference(both, F.col("before_label"), F.col("after_label"), **options)


def language_difference(data: DataFrame, outcome: str = "subject_1", before: str = "ita",
                        after: str = "eng", **options) -> DataFrame:
    """One language minus the other, in one pass over the rows of both."""
    label, lang = F.col(outcome), F.col("lang")
    return outcome_difference(data, F.when(lang == before, label),
                              F.when(lang == after, label), **options)


def followup_difference(data: DataFrame, first: str = "subject_1", second: str = "subject_2",
                        **options) -> DataFrame:
    """What the second question changed where the first answer was not OK."""
    missed = data.where(O.not_ok(F.col(first)))
    return outcome_difference(missed, F.col(first), F.col(second), **options)
