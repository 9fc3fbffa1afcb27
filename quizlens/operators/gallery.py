"""Gallery layout: which pictures, their captions and their cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quizlens.functions.paths import base_name, is_image
from quizlens.operators.lookups import lookup
from quizlens.values import EXCLUDED_NAME_PART, GALLERY_COLS, GALLERY_ROWS, SOURCES


def gallery_files(listing: DataFrame, sources: Sequence[str] = SOURCES,
                  excluded: str = EXCLUDED_NAME_PART) -> DataFrame:
    """Image files with the source their name contains, once per such source.

    ``source_order`` is the place of the source in the gallery. All sources are
    matched in one pass over the listing.
    """
    name = F.col("file")
    labels = [F.struct(F.lit(i).alias("source_order"), F.lit(s).alias("source"))
              for i, s in enumerate(sources)]
    matching = F.filter(F.array(*labels), lambda label: F.contains(name, label["source"]))
    return (
        listing.withColumn("file", base_name(F.col("path")))
        .where(is_image(name) & ~F.contains(name, F.lit(excluded)))
        .withColumn("_label", F.explode(matching))
        .withColumns({"source_order": F.col("_label.source_order"),
                      "source": F.col("_label.source")})
        .drop("_label")
    )


def caption_files(files: DataFrame, catalogue: DataFrame, strict: bool = True) -> DataFrame:
    """Add the caption: the subject, with two fixed exceptions by picture id."""
    name, subject = F.col("file"), F.col("subject")
    number = F.substring(F.substring_index(name, "_", 1), 2, 2147483647)
    catalogue_id = (
        F.when(F.contains(name, F.lit("i17")), F.lit(17))
        .when(F.contains(name, F.lit("i12")), F.lit(12))
        .otherwise(number.cast("int") if strict else number.try_cast("int"))
    )
    found = lookup(files.withColumn("catalogue_id", catalogue_id), catalogue,
                   "catalogue_id", "id", ["subject"], strict)
    caption = (
        F.when(F.contains(name, F.lit("i17")), F.when(subject.isNotNull(), F.lit("Torri")))
        .when(F.contains(name, F.lit("i12")), F.concat(subject, F.lit(" - Milano")))
        .otherwise(subject)
    )
    return found.withColumn("label", caption).drop("subject")


def place_in_grid(files: DataFrame, *tie_breaks: str, rows: int = GALLERY_ROWS,
                  cols: int = GALLERY_COLS) -> DataFrame:
    """The first ``rows * cols`` files by source and name, each with its cell.

    The limit comes first, as a top-k that every task applies to its own rows,
    so the window that numbers the files only sees one sheet.
    """
    keys = ["source_order", "file", *tie_breaks]
    sheet = files.orderBy(*keys).limit(rows * cols)
    position = F.row_number().over(Window.orderBy(*keys)) - 1
    return sheet.withColumn("position", position).withColumns({
        "grid_row": F.floor(F.col("position") / cols).cast("int"),
        "grid_col": (F.col("position") % cols).cast("int"),
    })
