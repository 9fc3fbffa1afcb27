"""Removal of repeated word sequences by seed and extend.

Seeds are winnowed anchors: of every window of ``length`` words, the word gram
with the smallest hash. Documents meet on equal seeds. A seed is extended both
ways at once: a run is all the text that windows around it reach, and runs with
equal content are extended to their full width. Where they differ, the repeat
ends inside the run, and the extension goes window by window. Windows that meet
again, side by side, are the maximal repeats of at least ``length`` words.

Null and empty texts have no words. Repeated rows are copies like any other; with
``keep_first`` one row of those that repeat doc_id and text counts as the first.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quizlens.llm import windows

LENGTH = 35  # words of a repeat
GRAM = 8     # words of a seed


def maximal_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (d, t, first, count, later): windows of ``with_keys`` documents that
    also start elsewhere; ``later``: also at an earlier position."""
    gram = min(gram, length)
    twins, open_rows = windows.repeated(windows.runs(docs, "words", length, gram), "seed-run")
    edges = windows.packed(docs).join(windows.lists(open_rows, "d", "t"), ["d", "t"])
    singles, _ = windows.repeated(windows.blocks(edges, "words", length, 1), "seed-single")
    return twins.unionByName(singles)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True,
                   with_text: bool = True, gram: int = GRAM) -> DataFrame:
    """Documents without the words that repeats cover.

    ``keep_first`` leaves the earliest of equal windows. Per document: doc_id,
    n_words, n_removed, n_repeats (maximal removed runs), kept_sha256 and, with
    ``with_text``, kept (words joined by one blank).
    """
    docs, copies = windows.distinct_rows(windows.with_keys(docs))
    spans = maximal_repeats(docs, length, gram)
    if keep_first:
        spans = spans.where("later")
    schema = "n_words long, n_removed long, n_repeats long, kept_sha256 string"

    def result(data, offsets, words, inside):
        bounds, n = words.bounds, np.diff(words.bounds)
        total = np.concatenate([[0], np.cumsum(inside)])
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        begin = bounds[:-1][n > 0]
        starts[begin] = inside[begin]
        begun = np.concatenate([[0], np.cumsum(starts)])
        # Each kept word and one blank after it, all copied in one step.
        size = words.ends[~inside] - words.starts[~inside] + 1
        ends = np.cumsum(size)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(
            words.starts[~inside] - (ends - size), size)
        left = np.append(data, np.uint8(32))[source]
        left[ends - 1] = 32
        left = left.tobytes()
        ends = np.concatenate([[0], ends])[bounds - total[bounds]].tolist()
        kept = [left[a:max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])]
        columns = [n, np.diff(total[bounds]), np.diff(begun[bounds]),
                   pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        if with_text:
            columns.append(pa.array([x.decode() for x in kept], pa.string()))
        return columns

    return windows.covered(docs, "words", spans, length,
                           schema + ", kept string" if with_text else schema, result, copies,
                           keep_first)
