"""Sorting and positional indexes without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quizlens.session import stored

_ROW = "_row"
_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def sort_rows(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in the order of ``keys``; equal rows take any order.

    A row number is the last key. It tells equal rows apart, so the range
    partitioner can cut through a key that holds a large share of all rows.
    """
    return data.withColumn(_ROW, F.monotonically_increasing_id()).orderBy(*keys, _ROW).drop(_ROW)


def combined_order(data: DataFrame) -> DataFrame:
    """Rows by path, then model."""
    return sort_rows(data, ["path", "model"])


def with_position(data: DataFrame, keys: Sequence[str], name: str = "index") -> DataFrame:
    """Add the zero-based position of each row in the order of ``keys``.

    The rows are sorted by range partitions and stored once in the shared
    folder. Each row then adds its place in its partition to the number of rows
    in earlier partitions; that last sum runs over one row per partition.
    Equal rows take any order.
    """
    mark, part = "_mark", "_part"
    ordered = stored(
        sort_rows(data, keys).withColumn(mark, F.monotonically_increasing_id()), "sorted"
    ).withColumn(part, F.shiftright(mark, _ROW_BITS))
    sizes = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    place = F.col(mark).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ordered.join(F.broadcast(offsets), part)
        .withColumn(name, F.col("_offset") + place)
        .drop(mark, part, "_offset")
    )
