"""Token ids in seekable Zstandard files.

A file is a row of independent Zstandard frames and, at its end, a skippable
frame with the seek table: compressed size, size and checksum (low 32 bits of
XXH64 of the content) of every frame. Any Zstandard tool can decompress it, and
a reader fetches only the frames it wants. A frame holds whole documents, about
``FRAME_IDS`` ids or one longer document:

    int64 n, int64 doc_id[n], int64 n_tokens[n], uint32 ids[...]   (little endian)

Documents are in ascending doc_id order within and across files; rows of equal
doc_id follow the hash of their text. A null doc_id is stored as -2**63 and so
comes first. Null and empty texts have just the end id. Repeated rows are
written each time. Without documents there are no files.

Tasks write under a name of their own and move the finished file; the manifest,
stored after all tasks ended, is what makes files count. A task that is run
again leaves an unused file at worst.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quizlens.llm.codes import pieces
from quizlens.llm.encoding import PIECE_BYTES, TOKENIZER, encoder_of
from quizlens.llm.windows import NO_ID, as_batch, column_of, with_keys
from quizlens.session import new_path, qualified

END_ID = 1
FRAME_IDS = 1 << 16
LEVEL = 3
TASK_IDS, MOST_TASKS = 1 << 23, 100_000  # ids that a reading task gets on average
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80

MANIFEST = ("file_no int, path string, frame int, first_doc long, last_doc long, n_docs int, "
            "n_ids long")


class FrameWriter:
    """Appends frames to an open file and closes it with the seek table."""

    def __init__(self, sink):
        self.sink, self.table = sink, []
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress

    def add(self, content: bytes) -> None:
        packed = self.compress(content)
        self.sink.write(packed)
        self.table.append((len(packed), len(content),
                           xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKED, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)))
        self.sink.write(entries + footer)
        self.sink.close()


class FrameReader:
    """Frames of one file by number, each checked against the seek table."""

    def __init__(self, path: str):
        filesystem, inner = pafs.FileSystem.from_uri(path)
        self.path, self.file = path, filesystem.open_input_file(inner)
        end = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or not flags & CHECKED:
            raise ValueError(f"{path}: no seek table with checksums")
        table = np.frombuffer(self.file.read_at(12 * frames, end - 9 - 12 * frames), "<u4")
        self.packed, self.size, self.check = table.reshape(-1, 3).T.astype(np.int64)
        self.start = np.cumsum(self.packed) - self.packed

    def frame(self, i: int) -> bytes:
        packed = self.file.read_at(int(self.packed[i]), int(self.start[i]))
        content = zstandard.ZstdDecompressor().decompress(
            packed, max_output_size=int(self.size[i]))
        if len(content) != self.size[i] or (
                xxhash.xxh64_intdigest(content) & 0xFFFFFFFF) != self.check[i]:
            raise ValueError(f"{self.path}: frame {i} fails its checksum")
        return content

    def documents(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id and n_tokens of a frame's documents, and all their ids."""
        content = self.frame(i)
        n = int(np.frombuffer(content, "<i8", 1)[0])
        head = np.frombuffer(content, "<i8", 2 * n, 8)
        return head[:n], head[n:], np.frombuffer(content, "<u4", offset=8 + 16 * n)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the ids of all texts below ``path``; returns the stored manifest."""
    spark = docs.sparkSession
    where = qualified(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, waiting, count = encoder_of(tokenizer), [], [], 0
        number = TaskContext.get().partitionId()
        filesystem, folder = pafs.FileSystem.from_uri(where)
        name = f"part-{number:06d}-{uuid.uuid4().hex}.zst"
        writer = None

        def flush() -> None:
            nonlocal writer, waiting, count
            if writer is None:
                filesystem.create_dir(folder, recursive=True)
                # The name would have the stream compressed once more.
                writer = FrameWriter(filesystem.open_output_stream(
                    f"{folder}/.{name}", compression=None))
            doc, size, ids = (np.concatenate(part) for part in zip(*waiting))
            rows.append((number, f"{where}/{name}", len(rows), int(doc[0]), int(doc[-1]),
                         len(doc), len(ids)))
            writer.add(np.int64(len(doc)).tobytes() + doc.astype("<i8").tobytes()
                       + size.astype("<i8").tobytes() + ids.astype("<u4").tobytes())
            waiting, count = [], 0

        for batch in batches:
            doc = column_of(batch, "d")
            for low, high, data, offsets in pieces(batch.column("text"), PIECE_BYTES):
                ids, bounds = encoder.encode(data, offsets)
                ids = np.insert(ids, bounds[1:], END_ID)
                bounds = bounds + np.arange(len(bounds))
                first = 0
                while first < high - low:
                    # Whole documents up to the frame's size, and one at least.
                    last = int(np.searchsorted(bounds, bounds[first] + FRAME_IDS - count,
                                               "right")) - 1
                    last = min(max(last, first + (not waiting)), high - low)
                    if last > first:
                        waiting.append((doc[low + first:low + last],
                                        np.diff(bounds[first:last + 1]),
                                        ids[bounds[first]:bounds[last]]))
                        count += int(bounds[last] - bounds[first])
                    if last < high - low:
                        flush()
                    first = last
        if waiting:
            flush()
        if writer is not None:
            writer.close()
            filesystem.move(f"{folder}/.{name}", f"{folder}/{name}")
        yield pa.RecordBatch.from_pylist(
            [dict(zip(MANIFEST_NAMES, row)) for row in rows], schema=MANIFEST_ARROW)

    keyed = with_keys(docs).select("d", "t", "text")
    manifest = keyed.repartitionByRange("d", "t").sortWithinPartitions("d", "t").mapInArrow(
        write, MANIFEST)
    manifest.write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


MANIFEST_NAMES = [part.split()[0] for part in MANIFEST.split(", ")]
MANIFEST_ARROW = pa.schema([
    (name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind])
    for name, kind in (part.split() for part in MANIFEST.split(", "))])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None,
                digest: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens and ids, or ids_crc32 for a digest.

    ``start`` is the number of ids of all documents before. With ``wanted``
    (a short list of doc_ids) only frames that can hold them are fetched.
    """
    # Ids before a file, then before a frame of it: one row per file, then per frame.
    files = manifest.groupBy("file_no").agg(F.sum("n_ids").alias("file_ids")).select(
        "file_no", (F.sum("file_ids").over(Window.orderBy("file_no")) - F.col("file_ids"))
        .alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("file_no").orderBy("frame")) - F.col("n_ids")
    frames = manifest.withColumn("inside", inside).join(files, "file_no").select(
        "path", "frame", "first_doc", "last_doc",
        (F.col("before") + F.col("inside")).alias("start"))
    if wanted is not None:
        hit = F.lit(False)
        for doc in wanted:
            hit = hit | F.lit(doc).between(F.col("first_doc"), F.col("last_doc"))
        frames = frames.where(hit)
    schema = "doc_id long, start long, n_tokens long, " + (
        "ids_crc32 long" if digest else "ids array<int>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            for path, frame, start in zip(*(batch.column(n).to_pylist()
                                            for n in ("path", "frame", "start"))):
                if reader is None or reader.path != path:
                    reader = FrameReader(path)
                doc, size, ids = reader.documents(frame)
                ends = np.cumsum(size)
                begin = ends - size
                keep = np.arange(len(doc)) if wanted is None else np.flatnonzero(
                    np.isin(doc, wanted))
                if digest:
                    raw = ids.tobytes()
                    last = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in
                                     zip(begin[keep].tolist(), ends[keep].tolist())], pa.int64())
                else:
                    last = pa.array([ids[a:b].astype(np.int32) for a, b in
                                     zip(begin[keep], ends[keep])], pa.list_(pa.int32()))
                named = pa.array(doc[keep], pa.int64(), mask=doc[keep] == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [named, pa.array(start + begin[keep]), pa.array(size[keep]), last],
                    names=[part.split()[0] for part in schema.split(", ")])

    # A manifest row is tiny and stands for a frame of ids, so the number of tasks
    # follows from the ids; by the bytes of the rows Spark would make it one.
    ids = manifest.agg(F.sum("n_ids")).first()[0] or 0
    tasks = min(-(-ids // TASK_IDS) or 1, MOST_TASKS)
    spread = frames.repartition(tasks, "path", F.expr("frame div 32")).sortWithinPartitions(
        "path", "frame")
    return spread.select("path", "frame", "start").mapInArrow(read, schema)


def roundtrip(docs: DataFrame) -> DataFrame:
    """Write all documents to a fresh folder and digest what the files hold."""
    return read_tokens(write_tokens(docs, new_path(docs.sparkSession, "tokens")), digest=True)
