"""Windows of a fixed length that occur more than once, found without comparing pairs.

Shared by the two removers of repeated text. Positions are counted in units
(bytes or words) from the start of a document. The steps are

1. ``runs``: the windows of every document, dealt to winnowed anchors. A run is
   one row for about a hundred neighbouring windows that share an anchor.
2. ``repeated``: runs with the same anchor *and* the same content are copies in
   all their windows. Anchors that occur once are done: their windows are unique.
3. What is left are runs whose anchor is repeated in other surroundings, at the
   edges of copies. ``cut`` and ``blocks`` take them apart into shorter rows of
   windows, down to single windows, and step 2 is repeated for those.

Every grouping is a count or a minimum and combines before its shuffle, and the
joins are between stored tables, so that a hot passage is split by adaptive
execution. Nothing gathers a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from quizlens.llm.codes import CONTENT, Runs, Sums, Words, mix, pieces, text_units
from quizlens.session import stored

NO_ID = -(1 << 63)
RUNS = "core long, content long, d long, t long, first int, count int, anchor int"
BLOCKS = "core long, content long, d long, t long, parent int, first int, count int, anchor int"


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the key (d, t) that tells rows apart.

    Rows that repeat a doc_id with another text are documents of their own; rows
    that repeat both are copies. A null doc_id is a value like any other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t"),
        "doc_id", "text")


def distinct_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row of ``with_keys`` documents per key, and (d, t, copies) of those that rows
    repeat; None without any. What repeats is equal in all that matters, so it takes
    part once, however often it is there."""
    copies = stored(docs.groupBy("d", "t").agg(F.count(F.lit(1)).alias("copies")).where(
        "copies > 1"), "repeated-rows")
    if copies.isEmpty():
        return docs, None
    keys = copies.select("d", "t")
    return docs.join(keys, ["d", "t"], "left_anti").unionByName(
        docs.join(keys, ["d", "t"], "left_semi").dropDuplicates(["d", "t"])), copies


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from the
    columns of ``docs``: working columns never touch those that a user brings."""
    taken = {column.lower() for column in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def as_batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [part.split() for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
             "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    arrays = [
        column if isinstance(column, pa.Array) else
        pa.array(column.view(np.int64) if getattr(column, "dtype", None) == np.uint64 else column,
                 kinds[kind])
        for column, (_, kind) in zip(columns, names)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in names])


def column_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def runs(docs: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """One row per run of each document of ``with_keys``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = column_of(batch, "d"), column_of(batch, "t")
            for low, high, data, offsets in pieces(batch.column("text")):
                codes, bounds = text_units(unit, data, offsets)
                found = Runs(codes, bounds, length, gram)
                if len(found.first):
                    row = np.searchsorted(bounds, found.first, "right") - 1
                    yield as_batch(RUNS, found.seed, found.content(), d[low:high][row],
                                   t[low:high][row], found.first - bounds[row], found.count,
                                   found.anchor - found.first)

    return docs.select("d", "t", "text").mapInArrow(emit, RUNS)


def packed(docs: DataFrame) -> DataFrame:
    """``with_keys`` documents with their text compressed: each of the joins that
    brings text to its windows moves half the bytes."""
    schema = "d long, t long, doc_id long, packed binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("d", "t", "doc_id")),
                 pa.array([compress(x) for x in text.to_pylist()], pa.binary())],
                names=["d", "t", "doc_id", "packed"])

    return docs.select("d", "t", "doc_id", "text").mapInArrow(emit, schema)


def unpacked(column: pa.Array) -> pa.Array:
    decompress = zstandard.ZstdDecompressor().decompress
    return pa.array([decompress(x) for x in column.to_pylist()], pa.large_binary())


def repeated(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows that have a twin, with the place of the first one; rows still open).

    A twin has the same core and content: all windows of both rows are equal one
    by one. Open is one row of each content whose core has several contents.
    """
    rows = stored(rows, f"{name}-rows")
    place = F.struct("d", "t", "first", *[c for c in ("parent", "count", "anchor")
                                          if c in rows.columns])
    kinds = stored(
        rows.groupBy("core", "content")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), f"{name}-kinds")
    mixed = stored(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"))
                   .where("kinds > 1").select("core"), f"{name}-mixed")
    open_rows = stored(kinds.join(mixed, "core", "left_semi").select("at.*"), f"{name}-open")
    first = kinds.where("n > 1").select(
        "core", "content", F.col("at.d").alias("d0"), F.col("at.t").alias("t0"),
        F.col("at.first").alias("first0"))
    twins = rows.join(first, ["core", "content"]).select(
        "d", "t", "first", "count",
        F.expr("not (d <=> d0 and t <=> t0 and first <=> first0)").alias("later"))
    return twins, open_rows


def lists(rows: DataFrame, *by: str) -> DataFrame:
    """The rows of a document, or of a part of it, as one list: bounded by its length."""
    return rows.groupBy(*by).agg(F.collect_list(F.struct("first", "count", "anchor")).alias("runs"))


def cut(docs: DataFrame, open_rows: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of each open run cover."""
    schema = "d long, t long, parent int, count int, anchor int, part binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = column_of(batch, "d"), column_of(batch, "t")
            for low, high, data, offsets in pieces(unpacked(batch.column("packed"))):
                row, first, count, anchor = unnest(batch.column("runs").slice(low, high - low))
                start = offsets[row] + first
                end = start + count + length - 1
                whole = data.tobytes()
                parts = [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]
                yield as_batch(schema, d[low:high][row], t[low:high][row], first, count, anchor,
                               pa.array(parts, pa.binary()))

    return packed(docs).join(lists(open_rows, "d", "t"), ["d", "t"]).select(
        "d", "t", "packed", "runs").mapInArrow(emit, schema)


def unnest(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row number, first, count and anchor of every run in a column of lists."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    inner = column.flatten()
    parts = [inner.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
    return np.repeat(np.arange(len(column)), sizes), *parts


def blocks(parts: DataFrame, unit: str, length: int, size: int) -> DataFrame:
    """Runs taken apart into rows of at most ``size`` windows.

    ``parts`` has bytes in ``part`` that begin at ``parent``, or whole documents
    in ``packed``, and ``runs`` in places of those bytes.

    A block holds windows whose distance from the anchor is in the same
    ``size``-wide range, so equal windows meet in equal blocks. The core is what
    all windows of the full range have in common.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t, parent = (column_of(batch, n) for n in ("d", "t", "parent"))
            text = batch.column(3)
            for low, high, data, offsets in pieces(unpacked(text) if whole else text):
                codes, bounds = text_units(unit, data, offsets)
                row, first, count, anchor = unnest(batch.column("runs").slice(low, high - low))
                if not len(row):
                    continue
                sums = Sums(codes, CONTENT)
                far, near = anchor, anchor - count + 1  # distances of first and last window
                parts = far // size - near // size + 1
                each = np.repeat(np.arange(len(row)), parts)
                block = near[each] // size + np.arange(len(each)) - np.repeat(
                    np.cumsum(parts) - parts, parts)
                nearest = np.maximum(block * size, near[each])
                farthest = np.minimum(block * size + size - 1, far[each])
                at = bounds[row][each] + first[each] + anchor[each]
                core = mix(sums.of(at - block * size, at - block * size - size + 1 + length)
                           + block.astype(np.uint64))
                start, n = at - farthest, farthest - nearest + 1
                content = mix(sums.of(start, start + n + length - 1) + farthest.astype(np.uint64))
                row = row[each]
                yield as_batch(BLOCKS, core, content, d[low:high][row], t[low:high][row],
                               parent[low:high][row], parent[low:high][row] + start - bounds[row],
                               n, farthest)

    whole = "packed" in parts.columns
    if whole:
        parts = parts.withColumn("parent", F.lit(0))
    return parts.select("d", "t", "parent", "packed" if whole else "part", "runs").mapInArrow(
        emit, BLOCKS)


def covered(docs: DataFrame, unit: str, spans: DataFrame, length: int, schema: str,
            result: Callable, copies: DataFrame | None = None, keep_first: bool = False
            ) -> DataFrame:
    """Apply ``result`` to pieces of documents and the units that ``spans`` windows cover.

    ``docs``, ``spans`` and ``copies`` are of ``distinct_rows``. All windows of a row that
    is repeated also start elsewhere, so all are covered in each of its copies, or with
    ``keep_first`` in all copies but one. ``result(data, offsets, words, inside)`` gets
    one boolean per unit and returns the columns of ``schema`` after doc_id.
    """
    per_doc = spans.groupBy("d", "t").agg(F.collect_list(
        F.struct("first", "count", F.lit(0).alias("anchor"))).alias("runs"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = column_of(batch, "whole")
            for low, high, data, offsets in pieces(unpacked(batch.column("packed"))):
                words = Words(data, offsets) if unit == "words" else None
                bounds = words.bounds if words else offsets
                row, first, count, _ = unnest(batch.column("runs").slice(low, high - low))
                change = np.zeros(bounds[-1] + 1, np.int32)
                np.add.at(change, bounds[row] + first, 1)
                np.add.at(change, bounds[row] + first + count + length - 1, -1)
                full = np.flatnonzero(whole[low:high] & (np.diff(bounds) >= length))
                np.add.at(change, bounds[full], 1)
                np.add.at(change, bounds[full + 1], -1)
                inside = np.cumsum(change)[:-1] > 0
                columns = result(data, offsets, words, inside)
                yield as_batch(f"doc_id long, {schema}",
                               batch.column("doc_id").slice(low, high - low), *columns)

    empty = F.array().cast("array<struct<first:int,count:int,anchor:int>>")
    rows = packed(docs).join(per_doc, ["d", "t"], "left").select(
        "d", "t", "doc_id", "packed", F.coalesce("runs", empty).alias("runs"))
    if copies is None:
        rows = rows.withColumn("whole", F.lit(False))
    else:
        each = F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))
        rows = rows.join(copies, ["d", "t"], "left").withColumn("copy", F.explode(each)).withColumn(
            "whole", F.col("copy") > 1 if keep_first else F.col("copies").isNotNull())
    return rows.select("doc_id", "packed", "runs", "whole").mapInArrow(
        emit, f"doc_id long, {schema}")
