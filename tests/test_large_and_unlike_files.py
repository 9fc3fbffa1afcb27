"""Quoted files read by byte ranges, and files with unlike headers."""

import csv
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from quizlens import schemas
from quizlens.sources import graded, headers, ranges, tables
from quizlens.sources.listing import list_files

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b b", "c")])


def quoted_text(rng, rows, end, last_end):
    out = io.StringIO()
    writer = csv.writer(out, delimiter="\t", lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    writer.writerow([f.name for f in SCHEMA])
    cells = ["x", "", 'say "hi"', "two\nlines", "\n", '"', '""\n"', "tab\there", "é日本🙂", "\r\n\n", "a,b|c", " "]
    data = [[rng.choice(cells) + rng.choice(["", "z" * rng.randint(0, 9)]) for _ in SCHEMA] for _ in range(rows)]
    writer.writerows(data)
    text = out.getvalue()
    return (text if last_end else text.removesuffix(end)), data


@pytest.mark.parametrize("end,last_end", [("\n", True), ("\r\n", True), ("\n", False)])
def test_records_are_whole_at_any_range(end, last_end):
    rng = random.Random(len(end))
    for rows in (0, 1, 40):
        text, _ = quoted_text(rng, rows, end, last_end)
        raw = text.encode()
        want, parity, begin = [], 0, 0
        for i, byte in enumerate(raw):  # one pass, byte by byte
            parity ^= byte == 0x22
            if byte == 0x0A and not parity:
                want.append((begin, raw[begin:i].removesuffix(b"\r")))
                begin = i + 1
        if begin < len(raw):
            want.append((begin, raw[begin:]))
        for size in (1, 2, 3, 7, 50, len(raw) + 5):
            got, odd = [], 0
            for first in range(0, len(raw), size):
                last = min(first + size, len(raw))
                file = pa.BufferReader(raw)
                got += ranges.records_of(file, len(raw), first, last, bool(odd))
                odd ^= raw[first:last].count(b'"') % 2
            assert got == want, (rows, size)


def test_a_large_quoted_file_is_many_tasks(spark, tmp_path):
    rng, folder = random.Random(5), tmp_path / "files"
    folder.mkdir()
    data = []
    for name, end, rows in (("one.tsv", "\n", 300), ("two {x}.tsv", "\r\n", 200)):
        text, rows = quoted_text(rng, rows, end, name == "one.tsv")
        data += rows
        (folder / name).write_bytes((b"\xef\xbb\xbf" if name == "one.tsv" else b"") + text.encode())
    (folder / "empty.tsv").write_bytes(b"")
    files = list_files(spark, str(folder))
    got = ranges.read_ranges(files, SCHEMA, "\t", range_bytes=512)
    assert got.rdd.getNumPartitions() > 20
    rows = sorted((tuple(r)[1:] for r in got.collect()), key=str)
    assert rows == sorted((tuple(c or None for c in row) for row in data), key=str) and len(rows) == 500
    assert ranges.read_ranges(files.where("false"), SCHEMA, "\t").collect() == []


def test_small_ranges_share_tasks(spark, tmp_path):
    data = []
    for i in range(3):
        text, rows = quoted_text(random.Random(i), 200, "\n", True)
        data += rows
        (tmp_path / f"{i}.tsv").write_bytes(text.encode())
    files = list_files(spark, str(tmp_path))
    cut = ranges.file_ranges(files, 16)
    assert cut.count() > 500
    got = ranges.read_ranges(files, SCHEMA, "\t", range_bytes=16)
    assert got.rdd.getNumPartitions() <= ranges.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert sorted((tuple(r)[1:] for r in got.collect()), key=str) == sorted(
        (tuple(c or None for c in row) for row in data), key=str)


def test_bad_files_are_errors(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tc\tb b\n1\t2\t3\n")
    (tmp_path / "y.tsv").write_text("a\tb b\tc\n1\t2\n")
    for name, text in (("x.tsv", "unlike header"), ("y.tsv", "MALFORMED|malformed|1\\t2")):
        files = list_files(spark, str(tmp_path), name)
        with pytest.raises(Exception, match=text):
            ranges.read_ranges(files, SCHEMA, "\t", range_bytes=4).collect()


def test_files_of_three_headers_are_one_table(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b,c\n1,x,\"p\nq\"\n")
    (tmp_path / "2.csv").write_text("﻿c,a\nr,2\n", encoding="utf-8")
    (tmp_path / "3 [z].csv").write_text('b,"d ""d"""\ny,w\n')
    (tmp_path / "4.csv").write_text("a,b,c\n3,,s\n")
    (tmp_path / "5.csv").write_text("")
    kinds = T.StructType([T.StructField("A", T.IntegerType()), T.StructField("B", T.StringType()),
                          T.StructField("C", T.StringType()), T.StructField("D", T.StringType())])
    names = {"a": "A", "b": "B", "c": "C", 'd "d"': "D"}
    groups = headers.header_groups(list_files(spark, str(tmp_path)), ",")
    assert sorted(len(p) for p in groups.values()) == [1, 1, 2]
    got = headers.read_unlike(spark, str(tmp_path), names, kinds, ",")
    assert sorted(map(str, (tuple(r)[:4] for r in got.collect()))) == sorted(map(str, [
        (1, "x", "p\nq", None), (2, None, "r", None), (None, "y", None, "w"), (3, None, "s", None)]))
    assert got.columns == ["A", "B", "C", "D", "file"]
    assert got.where("file like '%4.csv'").count() == 1
    del names["b"]
    with pytest.raises(ValueError, match="cannot read the header"):
        headers.read_unlike(spark, str(tmp_path), names, kinds, ",")
    assert headers.read_unlike(spark, str(tmp_path), names, kinds, ",", strict=False).where(
        "A = 1").first().B is None
    (tmp_path / "6.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="cannot read the header"):
        headers.read_unlike(spark, str(tmp_path), names, kinds, ",", strict=False)
    assert headers.read_unlike(spark, str(tmp_path), names, kinds, ",", "*.none").collect() == []


def test_graded_ranges_equal_the_plain_reader(spark, tmp_path):
    rows = spark.range(200).select(*[
        (F.col("id") % 9).cast("int").alias(f.name) if f.name == "id" else
        F.concat(F.lit(f'{f.name} "q"\n\t| '), "id").alias(f.name) for f in schemas.GRADED],
        F.when(F.col("id") % 2 == 0, "ita").otherwise("eng").alias("lang"))
    folder = str(tmp_path / "graded")
    tables.write_graded(rows, folder)
    plain = sorted(map(str, graded.read_graded(spark, folder).collect()))
    assert sorted(map(str, ranges.read_graded_ranges(spark, folder, range_bytes=1000).collect())) == plain
    assert ranges.read_graded_ranges(spark, folder, ["ita"], range_bytes=999).count() == 100
