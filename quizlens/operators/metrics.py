"""Accuracy and outcome counts.

Every metric is one grouped aggregation, so Spark combines rows before the
shuffle and a hot algorithm or picture costs no more than any other. With
``weight`` the input may be rows that already stand for several answers, as
:func:`outcome_cube` makes them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quizlens.functions import outcomes as O
from quizlens.values import LANG_TAGS, OUTCOMES

FLAGS = {
    "subject_accuracy": "subject_ok",
    "city_accuracy": "city_ok",
    "subject_accuracy_2q": "subject_ok_2q",
}
#: All tables of a report need one or the other, none both: the first is as small as
#: the number of models, the second grows with the pictures.
MODEL_KEYS = ("lang", "algorithm", "dataset", "subject_1", "city_1", "subject_2")
PICTURE_KEYS = ("lang", "picture", "subject_1", "city_1")


def _rows(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def _share(flag: str, weight: str | None) -> Column:
    value = F.col(flag).cast("int")
    if weight is None:
        return F.avg(value)
    return F.sum(value * F.col(weight)).cast("double") / F.sum(weight)


def outcome_cube(data: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Answers per combination of labels: tables over these keys follow from it."""
    return data.groupBy(*keys).agg(F.count(F.lit(1)).alias("answers"))


def outcome_cubes(data: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Answers by ``MODEL_KEYS`` and by ``PICTURE_KEYS`` from one pass, told apart by
    ``cube``: 'model' or 'picture'. Keys of the other one are null. Both also have the
    keys ``also``."""
    keys = [*also, *dict.fromkeys(MODEL_KEYS + PICTURE_KEYS)]
    sets = [[F.col(k) for k in (*also, *own)] for own in (MODEL_KEYS, PICTURE_KEYS)]
    return data.groupingSets(sets, *keys).agg(
        F.count(F.lit(1)).alias("answers"),
        F.when(F.grouping("picture") == 0, "picture").otherwise("model").alias("cube"))


def accuracy(data: DataFrame, by: Sequence[str] = ("algorithm", "dataset"),
             weight: str | None = None) -> DataFrame:
    """The share of right answers per group: subject, city, subject in two questions."""
    known = _keys_present(data, by)
    return known.groupBy(*by).agg(
        *[_share(flag, weight).alias(name) for name, flag in FLAGS.items()]
    )


def outcome_counts(data: DataFrame, by: Sequence[str], outcome: str,
                   weight: str | None = None) -> DataFrame:
    """Answers per group and outcome. Rows with a null key or outcome do not count."""
    keys = [*by, outcome]
    return (
        _keys_present(data, keys)
        .groupBy(*keys)
        .agg(_rows(weight).cast("bigint").alias("count"))
    )


def outcome_counts_by_language(data: DataFrame, outcome: str, by: Sequence[str] = ("picture",),
                               weight: str | None = None, tags: Mapping[str, str] = LANG_TAGS,
                               strict: bool = True) -> DataFrame:
    """Outcome counts of all languages in one table, ``OK (EN)`` beside ``OK (IT)``.

    ``lang_order`` is the order of ``tags``: English first. ``display_order`` is
    the order of the bars: by outcome, and within it the languages in reverse
    order; other outcomes than the usual come last. A language without a tag
    raises, or has a null outcome and comes last when not strict.
    """
    counts = outcome_counts(data, ["lang", *by], outcome, weight)
    known = F.array_position(F.array(*[F.lit(lang) for lang in tags]), F.col("lang"))
    order = F.when(known > 0, known - 1).otherwise(len(tags)).cast("int")
    tagged = O.tag_language(F.col(outcome), F.col("lang"), tags)
    if strict:
        tagged = F.coalesce(tagged, F.raise_error(F.concat(
            F.lit("no tag for language: "), "lang")).cast("string"))
    found = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col(outcome))
    place = F.when(found > 0, found - 1).otherwise(len(OUTCOMES))
    return counts.select(
        *by,
        tagged.alias(outcome),
        "count",
        order.alias("lang_order"),
        (place * len(tags) + F.abs(len(tags) - 1 - order)).cast("int").alias("display_order"),
    )


def _keys_present(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    present = [F.col(key).isNotNull() for key in keys]
    return data.where(reduce(lambda a, b: a & b, present))
