"""Writers for delimited tables, with or without a leading row-label column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quizlens.operators.ordering import combined_order, with_position
from quizlens.sources.graded import header_columns


#: Files with quoted line breaks are read by one task each.
MAX_ROWS_PER_FILE = 500_000


def write_table(data: DataFrame, path: str, sep: str = ",", index_keys: Sequence[str] = (),
                folder_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write with header. Blanks at the ends of cells are kept, unlike by default.

    With ``index_keys`` the first column is the position in their order. With
    ``folder_by`` one pass over the rows fills a folder per value.
    """
    if index_keys:
        columns = data.columns
        data = with_position(data, index_keys).select("index", *columns)
    (
        data.write.mode(mode).partitionBy(*folder_by)
        .option("sep", sep).option("header", True)
        .option("quote", '"').option("escape", '"')
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_graded(graded: DataFrame, folder: str) -> None:
    """Write graded rows tab-separated, with one ``…{lang}.tsv`` folder per language."""
    name = F.concat(F.lit("graded_"), F.col("lang"), F.lit(".tsv")).alias("file")
    write_table(graded.select(*header_columns(), name), folder, sep="\t", folder_by=["file"])


def write_combined(graded: DataFrame, path: str) -> None:
    """Write graded rows by path, ``|`` separated, after a column of row labels.

    The labels only tell rows apart, so they are unique but not consecutive and
    cost no second pass over the rows.
    """
    ordered = combined_order(graded)
    labelled = ordered.select(F.monotonically_increasing_id().alias("row_label"), *header_columns())
    write_table(labelled, path, sep="|")
