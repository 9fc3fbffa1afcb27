"""Secret scans with an incremental ledger of blobs.

Every version of every file is addressed by the SHA-256 of its text. The ledger
holds what was found in a blob under one version of the rules. A run scans only
pairs of blob and rule version that it does not hold, however many paths and
versions have that blob, and then joins the ledger back to all of them.

Spans are in code points, end exclusive, leftmost and non-overlapping per kind.
The three base kinds follow their fixed patterns; the kinds after them are added
by these rules and change nothing about the base ones. Null and empty texts are
the empty blob, without spans. Repeated rows are scanned once and reported each
time. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quizlens.llm.codes import pieces
from quizlens.llm.windows import with_keys
from quizlens.session import new_path, stored

RULES = "2"
# Kinds and patterns, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "private", "jwt", "bearer")
BASE = 3
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # the same as runs of [0-9a-f]+ of 24 and more
PRIVATE = re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
BEARER = re.compile(rb"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

SPANS = "array<struct<start:int,kind:int,end:int>>"


def scan(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in bytes, sorted."""
    found = []
    if b":" in text or b"=" in text:
        low = text.lower()
        if any(word in low for word in WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                      if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if b"PRIVATE KEY" in text:
        found += [(m.start(), 3, m.end()) for m in PRIVATE.finditer(text)]
    if b"eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in JWT.finditer(text)]
    if b"earer " in text:
        found += [(m.start(), 5, m.end()) for m in BEARER.finditer(text)]
    return sorted(found)


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Spans with places in code points: bytes that continue a character do not count."""
    if not spans or text.isascii():
        return [{"start": a, "kind": k, "end": b} for a, k, b in spans]
    begin = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    place = lambda at: int(begin[at - 1]) if at else 0
    return [{"start": place(a), "kind": k, "end": place(b)} for a, k, b in spans]


def known(spark: SparkSession, ledger: str, rules: str) -> DataFrame:
    """(blob_id, spans) that the ledger holds under ``rules``."""
    schema = f"blob_id binary, spans {SPANS}, rules string"
    try:
        table = spark.read.schema(schema).parquet(ledger)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        table = spark.createDataFrame([], schema)
    return table.where(F.col("rules") == rules).drop("rules")


def scan_new(versions: DataFrame, ledger: str, rules: str = RULES) -> DataFrame:
    """Scan blobs of ``versions`` (with_keys rows and blob_id) that are not in the ledger.

    The new entries are appended in one commit. Returns (d, t, doc_id, blob_id).
    """
    spark = versions.sparkSession
    paths = stored(versions.select("d", "t", "doc_id", "blob_id"), "ledger-paths")
    todo = paths.groupBy("blob_id").agg(F.min(F.struct("d", "t")).alias("at"))
    todo = stored(todo.join(known(spark, ledger, rules).select("blob_id"), "blob_id", "left_anti")
                  .select("at.d", "at.t", "blob_id"), "ledger-todo")
    schema = f"blob_id binary, spans {SPANS}"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for _, _, data, offsets in pieces(batch.column("text")):
                whole = data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = whole[a:b]
                    spans.append(in_code_points(text, scan(text)))
            yield pa.RecordBatch.from_arrays([batch.column("blob_id"), pa.array(spans, kind)],
                                             names=["blob_id", "spans"])

    texts = versions.select("d", "t", "text").join(todo, ["d", "t"]).select("blob_id", "text")
    # Rows that repeat id and text are one blob: their spans are the same.
    entries = texts.mapInArrow(emit, schema).groupBy("blob_id").agg(
        F.first("spans").alias("spans"))
    entries.withColumn("rules", F.lit(rules)).write.mode("append").partitionBy("rules").parquet(
        ledger)
    return paths


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: str = RULES) -> DataFrame:
    """Findings of every row of ``docs``: n_assign, n_access, n_hex, base_sha256 and spans.

    ``ledger`` is kept from run to run; without one each run starts afresh.
    """
    ledger = ledger or new_path(docs.sparkSession, "ledger")
    versions = with_keys(docs).withColumn("blob_id", F.unhex(F.sha2("text", 256)))
    paths = scan_new(versions, ledger, rules)
    found = known(docs.sparkSession, ledger, rules)
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    digest = found.select(
        "blob_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
    return paths.join(digest, "blob_id").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
