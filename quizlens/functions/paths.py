"""Picture facts that are coded in the file name ``i{id}_{source}[_more].{ext}``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from quizlens.values import IMAGE_SUFFIXES


def base_name(path: Column) -> Column:
    """The part after the last slash."""
    return F.substring_index(path, "/", -1)


def image_id(path: Column, strict: bool = True) -> Column:
    """The number in the first ``_`` part, with every ``i`` removed.

    Anything that is not a number raises, or is null when not strict.
    """
    head = F.substring_index(base_name(path), "_", 1)
    number = F.replace(head, F.lit("i"), F.lit("")).try_cast("int")
    if not strict:
        return number
    return F.coalesce(number, F.raise_error(F.concat(
        F.lit("no picture id in path: "), F.coalesce(path, F.lit("null")))).cast("int"))


def image_id_text(path: Column) -> Column:
    """The first ``_`` part with every ``i`` removed, as it stands: ``01`` stays ``01``."""
    return F.replace(F.substring_index(base_name(path), "_", 1), F.lit("i"), F.lit(""))


def source_class(path: Column, strict: bool = True) -> Column:
    """``wiki`` when the name contains it, else the second ``_`` part up to a dot.

    A name without a second part raises, or gives null when not strict.
    """
    name = base_name(path)
    second = F.get(F.split(name, "_"), F.lit(1))
    other = F.substring_index(second, ".", 1)
    if strict:
        other = F.when(name.isNotNull() & second.isNull(), F.raise_error(
            F.concat(F.lit("no source in file name: "), name)).cast("string")).otherwise(other)
    return F.when(F.contains(name, F.lit("wiki")), F.lit("wiki")).otherwise(other)


def is_image(name: Column, suffixes: Iterable[str] = IMAGE_SUFFIXES) -> Column:
    """The lower-cased name ends with one of the suffixes."""
    endings = "|".join(re.escape(suffix) for suffix in suffixes)
    return F.lower(name).rlike(f"({endings})\\z")
