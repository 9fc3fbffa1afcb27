"""Exact removal of repeated byte strings by longest previous factors.

The longest previous factor of a position is the longest string that starts
there and also starts at an earlier position. In suffix order all suffixes that
agree in their first ``length`` bytes stand together, so a factor reaches the
threshold if and only if the nearest smaller position before or after it in
that order belongs to the same group. Only agreement down to ``length`` matters,
and so suffixes are ordered to that depth alone: by a hash of those bytes and,
within equal ones, by position. The smaller neighbour of a group is then its
first position (a minimum), and ``later`` says that there is one.

Neighbouring suffixes that stay together in that order are ordered as one row
(``windows.py``); text whose winnowed anchor is unique never gets that far.

Nulls and empty texts have no bytes. Repeated rows are copies like any other; with
``keep_first`` one row of those that repeat doc_id and text counts as the first.
Documents shorter than ``length`` keep everything. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quizlens.llm import windows
from quizlens.session import stored

LENGTH = 400   # bytes of a string that counts as repeated
GRAM = 32      # bytes of an anchor
BLOCK = 24     # windows of a block at the edge of a copy


def previous_factors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                     block: int = BLOCK) -> DataFrame:
    """Rows (d, t, first, count, later) of ``with_keys`` documents.

    Each of the ``count`` strings of ``length`` bytes that start at ``first`` and
    after also starts elsewhere; ``later``: also at an earlier position, in the
    order of doc_id and place. A position can be in several rows.
    """
    gram = min(gram, length)
    twins, open_rows = windows.repeated(windows.runs(docs, "bytes", length, gram), "lpf-run")
    parts = stored(windows.cut(docs, open_rows, length), "lpf-part")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("count"), F.col("anchor")))
    edges, narrow = windows.repeated(
        windows.blocks(parts.withColumn("runs", whole), "bytes", length, block),
        "lpf-block")
    inner = windows.lists(
        narrow.withColumn("first", F.col("first") - F.col("parent")), "d", "t", "parent")
    singles, _ = windows.repeated(
        windows.blocks(parts.select("d", "t", "parent", "part").join(
            inner, ["d", "t", "parent"]), "bytes", length, 1),
        "lpf-single")
    return twins.unionByName(edges).unionByName(singles)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True,
                   with_text: bool = True, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Documents without the bytes that repeated strings cover.

    ``keep_first`` keeps the earliest of each group of equal strings and removes
    those that have a previous factor; otherwise all of them go. Per document:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and,
    with ``with_text``, kept (bytes: a cut can fall inside a character).
    """
    docs, copies = windows.distinct_rows(windows.with_keys(docs))
    spans = previous_factors(docs, length, gram, block)
    if keep_first:
        spans = spans.where("later")
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def result(data, offsets, _, inside):
        n = np.diff(offsets)
        total = np.concatenate([[0], np.cumsum(inside)])
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        begin = offsets[:-1][n > 0]
        starts[begin] = inside[begin]  # spans never run on into the next text
        begun = np.concatenate([[0], np.cumsum(starts)])
        left = data[~inside].tobytes()
        edges = (offsets - total[offsets]).tolist()
        kept = [left[a:b] for a, b in zip(edges[:-1], edges[1:])]
        columns = [n, np.diff(total[offsets]), np.diff(begun[offsets]),
                   pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        return [*columns, pa.array(kept, pa.binary())] if with_text else columns

    return windows.covered(docs, "bytes", spans, length,
                           schema + ", kept binary" if with_text else schema, result, copies,
                           keep_first)
