"""File listings and file contents."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import NativeFile, fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quizlens.functions.paths import base_name
from quizlens.session import qualified, stored

FOLDERS_PER_TASK = 50


def list_files(spark: SparkSession, folder: str, pattern: str | None = None,
               prefix: str | None = None, recursive: bool = False) -> DataFrame:
    """``path`` and ``length`` of the files in a folder; no file is opened.

    With ``prefix`` the path is the prefix and the file name, such as
    ``./dataset/i1_flore.jpg``, and the full address moves to ``uri``.
    """
    listing = _files(spark, folder, pattern, recursive).select("path", "length")
    return _with_prefix(listing, prefix)


def read_bytes(spark: SparkSession, folder: str, pattern: str | None = None,
               prefix: str | None = None, recursive: bool = False) -> DataFrame:
    """``path``, ``length`` and ``content`` of the files in a folder."""
    listing = _files(spark, folder, pattern, recursive).select("path", "length", "content")
    return _with_prefix(listing, prefix)


def list_tree(spark: SparkSession, folder: str, pattern: str | None = None,
              prefix: str | None = None) -> DataFrame:
    """``list_files`` of a folder and all below it, listed by tasks.

    Folders are opened level by level, many at a time; the driver starts with the top
    one and sees no name below it. As elsewhere in Spark, names that begin with ``.`` or
    ``_`` are left out, unless they are those of a column's folder. ``pattern`` is one
    of file names, with ``*``, ``?`` and ``[]``.
    """
    schema = "path string, length long, is_folder boolean"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                filesystem, path = fs.FileSystem.from_uri(quote(uri, safe="/:"))
                before = uri.rstrip("/").removesuffix(path.rstrip("/"))
                rows = []
                for entry in filesystem.get_file_info(fs.FileSelector(path)):
                    name, is_folder = entry.base_name, entry.type == fs.FileType.Directory
                    hidden = name.startswith(".") or name.startswith("_") and "=" not in name
                    if not hidden and (is_folder or pattern is None or fnmatchcase(name, pattern)):
                        rows.append({"path": before + entry.path, "is_folder": is_folder,
                                     "length": 0 if is_folder else entry.size})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [("path", pa.string()), ("length", pa.int64()), ("is_folder", pa.bool_())]))

    level, n, files = spark.createDataFrame([(qualified(spark, folder),)], "path string"), 1, []
    while n:
        dealt = level.select("path").repartition(-(-n // FOLDERS_PER_TASK), "path")
        entries = stored(dealt.mapInArrow(emit, schema), "listing")
        files.append(entries.where("not is_folder").select("path", "length"))
        level = entries.where("is_folder")
        n = level.count()
    return _with_prefix(reduce(DataFrame.unionByName, files), prefix)


def _files(spark: SparkSession, folder: str, pattern: str | None, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def _with_prefix(listing: DataFrame, prefix: str | None) -> DataFrame:
    if prefix is None:
        return listing
    return listing.withColumns({
        "uri": F.col("path"),
        "path": F.concat(F.lit(prefix), base_name(F.col("path"))),
    })


def open_uri(uri: str, stream: bool = False) -> NativeFile:
    """One file, opened in a task by its address: from front to back, or at any place."""
    filesystem, path = fs.FileSystem.from_uri(quote(uri, safe="/:"))
    return filesystem.open_input_stream(path) if stream else filesystem.open_input_file(path)


def load_bytes(uri: str) -> bytes:
    """The content of one file, for a responder that opens pictures in its task.

    So the pictures go from storage to the task that asks about them, and never
    through a shuffle.
    """
    with open_uri(uri) as file:
        return file.read()
