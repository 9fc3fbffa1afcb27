"""Graded answers: one tab-separated file per model and language, and their union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from quizlens import schemas
from quizlens.values import LANG_TAGS

LANGS = tuple(LANG_TAGS)
#: What tells a file from another one, and from itself before it was replaced.
FILE_KEYS = {"file": "_metadata.file_path", "file_size": "_metadata.file_size",
             "file_time": "_metadata.file_modification_time"}
_HEADER = T.StructType([
    T.StructField(header, schemas.GRADED[name].dataType)
    for header, name in schemas.GRADED_HEADER.items()
])


def header_columns() -> list[Column]:
    """The columns under the names and in the order that the files use."""
    return [F.col(name).alias(header) for header, name in schemas.GRADED_HEADER.items()]


def delimited(spark: SparkSession, schema: T.StructType, sep: str, strict: bool,
              multi_line: bool) -> DataFrameReader:
    """A reader of quoted files with a checked header.

    Strict raises on a row with too few or too many fields, whichever columns are
    asked for, and on an id that is no number where ids are read; otherwise
    surplus fields go and bad numbers are null. ``multi_line`` keeps line breaks inside quotes; a file
    is then one task, and writers make many files. Without it large files are
    split, and a quoted line break is an error when strict.
    """
    return (
        spark.read.schema(schema)
        .option("sep", sep).option("header", True).option("enforceSchema", False)
        .option("quote", '"').option("escape", '"')
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("columnPruning", False).option("multiLine", multi_line)
    )


def graded_files(spark: SparkSession, folder: str, langs: Sequence[str] = LANGS) -> DataFrame:
    """path, size and time of the graded files of these languages; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select(*FILE_KEYS.values()).toDF(*FILE_KEYS).where(
        F.col("file").rlike(_pattern(langs)))


def _pattern(langs: Sequence[str]) -> str:
    return rf"({'|'.join(langs)})\.tsv"


def read_graded(spark: SparkSession, folder: str | Sequence[str], langs: Sequence[str] = LANGS,
                strict: bool = True, multi_line: bool = True, file_keys: bool = False) -> DataFrame:
    """All graded files of these languages in one scan, with a ``lang`` column.

    In place of a folder the files themselves can be given. With ``file_keys`` every row
    has the address, size and time of its file too. A file whose header differs is an
    error; ``headers.read_unlike`` reads such files.
    """
    paths = [f"{folder}/*{lang}.tsv" for lang in langs] if isinstance(folder, str) else list(folder)
    raw = delimited(spark, _HEADER, "\t", strict, multi_line).csv(paths)
    return raw.select(
        *[F.col(h).alias(n) for h, n in schemas.GRADED_HEADER.items()],
        F.regexp_extract(F.col("_metadata.file_path"), _pattern(langs), 1).alias("lang"),
        *([F.col(c).alias(n) for n, c in FILE_KEYS.items()] if file_keys else []),
    )


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """The union by column name; a column that one frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_combined(spark: SparkSession, path: str, row_labels: str | None = "row_label",
                  strict: bool = True, multi_line: bool = True) -> DataFrame:
    """A combined file. Its leading row labels are dropped.

    ``row_labels`` is the header of their column: ours by default, empty in files
    that pandas wrote, and None in files without such a column.
    """
    fields = list(_HEADER)
    if row_labels is not None:
        fields = [T.StructField(row_labels or "_c0", T.LongType()), *fields]
    raw = delimited(spark, T.StructType(fields), "|", strict, multi_line).option(
        "enforceSchema", row_labels == "").csv(path)
    return raw.select(*[F.col(h).alias(n) for h, n in schemas.GRADED_HEADER.items()])


def score_value(score: Column) -> Column:
    """A hand-typed score such as ``0,5`` or ``*0,5`` as a number, else null."""
    bare = F.ltrim(score, F.lit("*"))
    return F.replace(bare, F.lit(","), F.lit(".")).try_cast("double")
