"""Outcome predicates and labels with explicit null handling.

An outcome is ``OK``, ``NO``, ``ERR``, sometimes ``PAR``, or null. A missing
label is never OK, and it does count as "not OK": plain ``!=`` would lose it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from quizlens.values import (
    DISPLAY_NAMES,
    LANG_SUFFIX_LENGTH,
    LANG_TAGS,
    OK,
    PICTURE_NAME_NOISE,
)


def is_ok(outcome: Column) -> Column:
    """True for OK, false for anything else including null."""
    return outcome.eqNullSafe(F.lit(OK))


def not_ok(outcome: Column) -> Column:
    """True for anything but OK, null included."""
    return ~is_ok(outcome)


def is_ok_in_two(first: Column, second: Column) -> Column:
    """Right at the first question, or wrong there and right at the second."""
    return is_ok(first) | is_ok(second)


def without_lang(model: Column) -> Column:
    """The model name without its four-character language suffix."""
    kept = F.greatest(F.length(model) - F.lit(LANG_SUFFIX_LENGTH), F.lit(0))
    return F.left(model, kept)


def display_name(raw: Column, names: Mapping[str, str] = DISPLAY_NAMES,
                 strict: bool = True) -> Column:
    """The display name of a raw model name, from a small literal map.

    An unknown name raises, or stays null when not strict.
    """
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    found = F.create_map(*pairs)[raw]
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(
        F.lit("no display name for: "), F.coalesce(raw, F.lit("null")))).cast("string"))


def picture_key(city: Column, subject: Column, noise: str = PICTURE_NAME_NOISE) -> Column:
    """``city / subject`` without the noise part; null when either is null."""
    return F.concat(city, F.lit(" / "), F.replace(subject, F.lit(noise), F.lit("")))


def tag_language(outcome: Column, lang: Column,
                 tags: Mapping[str, str] = LANG_TAGS) -> Column:
    """The outcome followed by its language tag, such as ``OK (EN)``."""
    pairs = [F.lit(x) for pair in tags.items() for x in pair]
    return F.concat(outcome, F.create_map(*pairs)[lang])
