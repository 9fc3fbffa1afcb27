"""Delimited files whose headers differ, read as one table.

The header of every file is read in a task. Files of equal headers are one group
and one read; the groups are joined by column name, and a column that a group
lacks is null there. The order of columns may differ from file to file.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quizlens.sources.graded import combine, delimited
from quizlens.sources.listing import list_files, open_uri

FILES_PER_TASK = 200
#: Column of the result with the address of the file a row is from.
FILE = "file"


def file_headers(files: DataFrame, sep: str) -> DataFrame:
    """``path`` and ``header`` (the names of its columns) of files that are not empty.

    Nothing but the first record of a file is read; it may hold quoted line breaks.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, headers = batch.column("path").to_pylist(), []
            for path in paths:
                with open_uri(path, stream=True) as file, io.TextIOWrapper(
                        file, "utf-8-sig", newline="") as text:
                    headers.append(next(csv.reader(text, delimiter=sep), None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(headers, pa.list_(pa.string()))],
                names=["path", "header"])

    tasks = -(-files.count() // FILES_PER_TASK) or 1
    return files.select("path").repartition(tasks).mapInArrow(
        emit, "path string, header array<string>").where("header is not null")


def header_groups(files: DataFrame, sep: str) -> dict[tuple[str, ...], list[str]]:
    """The files of every header.

    The driver holds the paths, as Spark's own index of the files to read does.
    """
    rows = file_headers(files, sep).groupBy("header").agg(
        F.sort_array(F.collect_list("path")).alias("paths")).collect()
    return {tuple(r.header): r.paths for r in sorted(rows, key=lambda r: r.header)}


def literal_path(path: str) -> str:
    """A path in which no character stands for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_unlike(spark: SparkSession, folder: str, columns: Mapping[str, str], schema: T.StructType,
                sep: str, pattern: str | None = None, recursive: bool = False,
                strict: bool = True, multi_line: bool = True) -> DataFrame:
    """All rows of the folder's files in the columns of ``schema``, and ``file``.

    ``columns`` leads from the names in the files to those of ``schema``. A header that
    names a column twice is an error, as is, if strict, one that is not in ``columns``;
    otherwise such columns are left out. Without files the result is empty.
    """
    files = list_files(spark, folder, pattern, recursive=recursive)
    columns_of_all = [*schema.fields, T.StructField(FILE, T.StringType())]
    frames = [spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name)
                                      for f in columns_of_all])]
    for header, paths in header_groups(files, sep).items():
        unknown = [name for name in header if name not in columns]
        if len(set(header)) < len(header) or (strict and unknown):
            raise ValueError(f"{paths[0]}: cannot read the header {list(header)}")
        kinds = T.StructType([T.StructField(name, schema[columns[name]].dataType
                                            if name in columns else T.StringType())
                              for name in header])
        group = delimited(spark, kinds, sep, strict, multi_line).csv(
            [literal_path(path) for path in paths])
        frames.append(group.select(
            *[F.col(f"`{name}`").alias(columns[name]) for name in header if name in columns],
            F.col("_metadata.file_path").alias(FILE)))
    return combine(frames)
