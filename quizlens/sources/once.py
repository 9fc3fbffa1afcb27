"""Answers appended exactly once, lines and side rows in one pass.

Tasks write to a hidden staging folder and report their files. The driver then
writes one marker, named after the run, that lists all moves, and moves the
files. The marker is the commit: a run whose marker is there adds nothing, and
moves that a stopped driver left undone are made up for by the next append of
that run. A task or job that fails leaves no visible file.

A task that is being stopped may still write when the driver clears up. So the driver
makes the staging folder, tasks make none but those inside it, and clearing up moves it
away before it is deleted: what comes later finds no folder and ends there.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quizlens.session import qualified

_FORMAT = "quizlens_once"
_ROW_ID = re.compile("[A-Za-z0-9_.-]+")
# Fixed values of Spark's folder names: characters written as %XX, and the name for null.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    filesystem, path = fs.FileSystem.from_uri(quote(uri, safe="/:"))
    return filesystem, path.rstrip("/")


def folder_name(name: str, value: str | None) -> str:
    if value is None or value == "":
        return f"{name}={_NULL_FOLDER}"
    return f"{name}=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value)


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task: (where it is, where it goes), both below the folder of lines
    (False) or of side rows (True)."""

    moves: list[tuple[bool, str, str]] = field(default_factory=list)


class OnceWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.side, self.run = (options[k] for k in ("path", "side", "run"))
        self.folders = json.loads(options["folders"])
        self.staging = options["staging"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        filesystem, root = open_folder(self.path)
        task, out = uuid.uuid4().hex, Staged()
        streams: dict[str, pa.NativeFile] = {}
        side = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            unsafe = pc.is_valid(table["_reason"])
            for folder, lines in self.by_folder(table.filter(pc.invert(unsafe))):
                if folder not in streams:
                    name = f"{folder}{self.run}-{task}.txt"
                    below_staging(filesystem, f"{root}/{self.staging}", folder)
                    streams[folder] = filesystem.open_output_stream(
                        f"{root}/{self.staging}/{name}")
                    out.moves.append((False, f"{self.staging}/{name}", name))
                streams[folder].write(("\n".join(lines) + "\n").encode())
            rows = table.filter(unsafe).drop_columns(["_line"])
            if len(rows):
                rows = rows.rename_columns([*rows.column_names[:-1], "reason"])
                if side is None:
                    to, below = open_folder(self.side)
                    name = f"{self.run}-{task}.parquet"
                    side = pq.ParquetWriter(f"{below}/{self.staging}/{name}", rows.schema,
                                            filesystem=to)
                    out.moves.append((True, f"{self.staging}/{name}", name))
                side.write_table(rows)
        for open_file in [*streams.values(), *([side] if side else [])]:
            open_file.close()
        return out

    def by_folder(self, table: pa.Table) -> Iterator[tuple[str, list[str]]]:
        """The lines of each folder of a batch."""
        found: dict[str, list[str]] = {}
        names = [table[c].to_pylist() for c in self.folders]
        for line, *values in zip(table["_line"].to_pylist(), *names):
            key = "".join(folder_name(n, v) + "/" for n, v in zip(self.folders, values))
            found.setdefault(key, []).append(line)
        return iter(found.items())

    def commit(self, messages: list[Staged | None]) -> None:
        filesystem, root = open_folder(self.path)
        marker = f"{root}/_runs/{self.run}.json"
        for folder in (self.path, self.side):
            to, below = open_folder(folder)
            to.create_dir(below, recursive=True)
        if not _exists(filesystem, marker):
            moves = [move for message in messages if message for move in message.moves]
            filesystem.create_dir(f"{root}/_runs", recursive=True)
            draft = f"{root}/_runs/_{uuid.uuid4().hex}"
            with filesystem.open_output_stream(draft) as file:
                file.write(json.dumps({"staging": self.staging, "moves": moves}).encode())
            filesystem.move(draft, marker)
        with filesystem.open_input_file(marker) as file:
            committed = json.loads(file.read())
        self.finish(committed)
        self.clear(committed["staging"])
        self.clear(self.staging)

    def finish(self, committed: dict) -> None:
        """Make the moves of a committed run that were not made yet."""
        for to_side, staged, final in committed["moves"]:
            to, below = open_folder(self.side if to_side else self.path)
            if _exists(to, f"{below}/{staged}"):
                to.create_dir(f"{below}/{final}".rpartition("/")[0], recursive=True)
                to.move(f"{below}/{staged}", f"{below}/{final}")

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear(self.staging)

    def clear(self, staging: str) -> None:
        for folder in {self.path, self.side}:
            to, below = open_folder(folder)
            if _exists(to, f"{below}/{staging}"):
                gone = f"{below}/_staging_cleared-{uuid.uuid4().hex}"
                to.move(f"{below}/{staging}", gone)
                to.delete_dir(gone)


def below_staging(filesystem: fs.FileSystem, staging: str, folder: str) -> None:
    """Make the folders of ``folder`` in the staging folder, which has to be there."""
    path = staging
    for name in filter(None, folder.split("/")):
        path += f"/{name}"
        if not _exists(filesystem, path):
            filesystem.create_dir(path, recursive=False)


def _exists(filesystem: fs.FileSystem, path: str) -> bool:
    return filesystem.get_file_info(path).type != fs.FileType.NotFound


class OnceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def writer(self, schema, overwrite: bool) -> OnceWriter:
        return OnceWriter(dict(self.options))


def append_once(rows: DataFrame, line: str, reason: str, path: str, side: str, run: str,
                folders: Sequence[str] = ()) -> None:
    """Append ``line`` of every row to text files below ``path``, in a folder per value
    of ``folders``; rows with a ``reason`` go to ``side`` as Parquet, with all other
    columns. A ``run`` that was appended before adds nothing.

    Both columns are computed once per row, in the task that writes it.
    """
    if not _ROW_ID.fullmatch(run):
        raise ValueError(f"a run is named by letters, digits, '_', '.' and '-': {run}")
    spark = rows.sparkSession
    spark.dataSource.register(OnceSource)
    others = [c for c in rows.columns if c not in (line, reason)]
    # Of rows that become lines nothing else is sent to the writer.
    kept = [F.col(c) if c in folders else F.when(F.col(reason).isNotNull(), F.col(c)).alias(c)
            for c in others]
    staging = f"_staging/{run}-{uuid.uuid4().hex}"
    for folder in (path, side):
        to, below = open_folder(qualified(spark, folder))
        to.create_dir(f"{below}/{staging}", recursive=True)
    rows.select(*kept, F.col(line).alias("_line"), F.col(reason).alias("_reason")).write.format(
        _FORMAT).mode("append").options(
        path=qualified(spark, path), side=qualified(spark, side), run=run, staging=staging,
        folders=json.dumps(list(folders))).save()
