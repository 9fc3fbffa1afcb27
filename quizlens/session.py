"""Session settings and the shared folder for intermediate files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quizlens", master: str | None = None,
                  **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC time.

    ``master`` is left to spark-submit unless given. Extra settings win.
    """
    config = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Keep batches to the responder small in bytes: rows may hold pictures.
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        **settings,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in config.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a
    cluster without it is an error, as other machines could not read one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
        folder = tempfile.mkdtemp(prefix="quizlens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Spark's default filesystem completes it.

    Python tasks get it in this form: without a scheme they would take a shared path
    for one on their own disk.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return filesystem.makeQualified(hadoop).toString()


_RUN_FOLDERS: list[str] = []


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all intermediate tables made inside the block, removed at its end.

    Results must be written before the end: what is read later is gone.
    """
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    _RUN_FOLDERS.append(folder)
    try:
        yield folder
    finally:
        _RUN_FOLDERS.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, under the open run folder or the shared folder."""
    folder = _RUN_FOLDERS[-1] if _RUN_FOLDERS else shared_dir(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, folder_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What follows starts from the files: it survives lost executors without
    computing the rows again, sees the same rows each time, and reads only the
    columns it needs. ``folder_by`` deals the rows to a folder per value, and a
    reader of one value opens no other.
    """
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*folder_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
