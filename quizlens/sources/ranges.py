"""Quoted delimited files of any size, read by many tasks.

A line break ends a record unless it stands in quotes, and whether it does depends on
all quotes before it. So the files are cut into ranges of bytes, and

1. every range counts its quotes; only whether the number is odd matters,
2. a running sum over the ranges of a file, one row each, tells for every range
   whether it begins inside quotes,
3. every range hands out the records that begin in it, reading on beyond its end
   until the last of them is whole, and
4. Spark parses the records.

A doubled quote inside quotes changes nothing about that. A quote that stands in a
field without quotes around it does: such files are no quoted files.

Neighbouring ranges are dealt to tasks by their bytes, so small ranges make no small tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quizlens import schemas
from quizlens.session import stored
from quizlens.sources.graded import LANGS
from quizlens.sources.listing import list_files, open_uri

RANGE_BYTES = 32 << 20
TASK_BYTES = 32 << 20
OPEN_BYTES = 4 << 20  # what opening a file costs, in bytes read
TASKS_PER_CORE = 4
FIRST_AHEAD_BYTES = 16 << 10
AHEAD_BYTES = 1 << 20
MOST_TASKS = 100_000
_QUOTE, _BREAK, _RETURN = b'"\n\r'
_BOM = b"\xef\xbb\xbf"


def dealt(ranges: DataFrame) -> DataFrame:
    """The ranges in tasks of about ``TASK_BYTES``, neighbours together, or smaller ones
    while all cores can have ``TASKS_PER_CORE``."""
    n, size, files = ranges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)),
        F.count(F.when(F.col("first") == 0, True))).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    tasks = min(n, MOST_TASKS, max(TASKS_PER_CORE * cores, -(-(size + files * OPEN_BYTES) // TASK_BYTES)))
    return ranges.repartitionByRange(tasks or 1, "path", "first")


def opened(rows: Iterable[dict]) -> Iterator[tuple[dict, pa.NativeFile]]:
    """Each range with its file, which stays open from one range to the next."""
    for path, ranges in groupby(rows, itemgetter("path")):
        with open_uri(path) as file:
            for row in ranges:
                yield row, file


def file_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, first, last (not included) and inside: whether ``first`` stands in quotes."""
    cut = files.where("length > 0").select("path", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("first"),
        "length").select("path", "first", F.least("length", F.col("first") + range_bytes).alias("last"))
    cut = dealt(stored(cut, "ranges"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = []
            for row, file in opened(batch.to_pylist()):
                n = 0
                for at in range(row["first"], row["last"], 8 << 20):
                    n += file.read_at(min(8 << 20, row["last"] - at), at).count(b'"')
                odd.append(n % 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(odd, pa.int32())], names=[*batch.schema.names, "odd"])

    counted = cut.mapInArrow(emit, "path string, first long, last long, odd int")
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return stored(counted.select("path", "first", "last", (
        F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")), "ranges-state")


def records_of(file: pa.NativeFile, size: int, first: int, last: int, inside: bool
               ) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of all records that begin from ``first`` to before ``last``."""
    data = file.read_at(last - first, first)
    # A range begins with a record if the byte before it is a break outside quotes.
    starts_here = first == 0 or (not inside and file.read_at(1, first - 1) == b"\n")
    state, scanned, ends, ahead = int(inside), 0, np.zeros(0, np.int64), FIRST_AHEAD_BYTES
    while True:
        part = np.frombuffer(data, np.uint8, offset=scanned)
        quotes = np.cumsum(part == _QUOTE, dtype=np.uint8)
        found = np.flatnonzero((part == _BREAK) & ((quotes + np.uint8(state)) % 2 == 0))
        ends = np.concatenate([ends, found + scanned])
        state = (state + int(quotes[-1])) % 2 if len(part) else state
        scanned = len(data)
        # The record that ends here began before the end of the range, or none is left.
        if first + scanned >= size or (len(ends) and first + int(ends[-1]) + 1 >= last):
            break
        data += file.read_at(min(ahead, size - first - scanned), first + scanned)
        ahead = min(4 * ahead, AHEAD_BYTES)
    if first + scanned >= size and (not len(ends) or ends[-1] != scanned - 1):
        ends = np.append(ends, scanned)  # the last record of a file without a last break
    bounds = ends + 1
    begin = 0 if starts_here else int(bounds[0]) if len(bounds) else scanned
    for end in bounds[bounds > begin].tolist():
        if first + begin >= last:
            break
        record = data[begin:end - 1]
        yield first + begin, record[:-1] if record.endswith(b"\r") else record
        begin = end


def records(ranges: DataFrame) -> DataFrame:
    """path, at (offset in the file) and record of all records that are not empty."""
    schema = "path string, at long, record string"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, file in opened(batch.to_pylist()):
                at, texts = [], []
                for place, record in records_of(file, file.size(), row["first"], row["last"],
                                                row["inside"]):
                    text = (record.removeprefix(_BOM) if place == 0 else record).decode(
                        "utf-8", "replace")
                    if text:
                        at.append(place)
                        texts.append(text)
                    if len(at) == 10_000:
                        yield batch_of(row["path"], at, texts)
                        at, texts = [], []
                yield batch_of(row["path"], at, texts)

    def batch_of(path: str, at: list[int], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64()),
             pa.array(texts, pa.string())], names=["path", "at", "record"])

    return dealt(ranges).mapInArrow(emit, schema)


def _parsed(record: Column, schema: T.StructType, sep: str, strict: bool) -> Column:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return F.from_csv(record, ddl, {
        "sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "columnPruning": "false",
        "mode": "FAILFAST" if strict else "PERMISSIVE"})


def read_ranges(files: DataFrame, schema: T.StructType, sep: str, strict: bool = True,
                range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of files (path, length) with a header, in the columns of ``schema``, and
    ``path``. A header that differs from ``schema`` is an error."""
    found = records(file_ranges(files, range_bytes))
    names = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    header = F.array(*[_parsed(F.col("record"), names, sep, strict)[f.name] for f in schema])
    right = header == F.array(*[F.lit(f.name) for f in schema])
    wrong = F.raise_error(F.concat(F.col("path"), F.lit(": unlike header: "), F.col("record")))
    body = found.where(F.when(F.col("at") > 0, True).when(right, False).otherwise(
        wrong.cast("boolean")))
    return body.select("path", _parsed(F.col("record"), schema, sep, strict).alias("row")).select(
        "path", "row.*")


def read_graded_ranges(spark: SparkSession, folder: str, langs: Sequence[str] = LANGS,
                       strict: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``graded.read_graded`` for files of any size: a file is as many tasks as it has ranges."""
    files = list_files(spark, folder, "*", recursive=True)
    pattern = rf"({'|'.join(langs)})\.tsv(/[^/]*)?$"
    files = files.where(F.col("path").rlike(pattern))
    fields = T.StructType([T.StructField(header, schemas.GRADED[name].dataType)
                           for header, name in schemas.GRADED_HEADER.items()])
    rows = read_ranges(files, fields, "\t", strict, range_bytes)
    return rows.select(*[F.col(f"`{h}`").alias(n) for h, n in schemas.GRADED_HEADER.items()],
                       F.regexp_extract("path", pattern, 1).alias("lang"))
