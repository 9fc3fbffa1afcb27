"""Spelling variants: words one edit apart, each led to the far more frequent one.

Words of all texts are counted first; what follows works on distinct words. The
letters of a word are hashed to a few symbols, which gives its reduced word. All
reduced words that are one edit or none away from it are generated and joined
with the reduced words of the vocabulary. One edit of a word is at most one edit
of its reduced word, so nothing is missed; what meets is verified on the
original strings. A neighbourhood has no row twice, so each pair meets once from
either side, and the size of a neighbourhood depends on the word's length alone.

Null and empty texts have no words; a null doc_id counts as an empty one in the
checksum. Repeated rows count each time. Ties of equally frequent neighbours go
to the smallest word in code-point order. Extra columns are ignored. Without
documents or without words that are frequent enough the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quizlens.session import stored

# Fixed values of the contract.
LEAST_LETTERS, LEAST_COUNT, FACTOR, DELETE_EVERY = 6, 5, 5, 199

SYMBOLS = 8
TASK_WORDS = 20_000   # whose neighbourhoods a task generates
KEPT_WORDS = 200_000  # counted by a task before it hands them on
_KEY = "reduced string, word string, n long"


def words_of(doc_id: int | None, text: str, least: int = LEAST_LETTERS) -> Counter:
    """Counts of a text's words with at least ``least`` code points.

    A run whose checksum with the doc_id ``DELETE_EVERY`` divides has lost a letter.
    """
    # Bytes, as str.lower would change more than A-Z.
    lowered = text.encode().lower().decode()
    runs = Counter(re.findall(f"[a-zÀ-ÿ]{{{least},}}", lowered))
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), prefix)
        if h % DELETE_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= least:
            found[run] += n
    return found


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, for words with enough letters and occurrences in all of ``docs``."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def handed_on() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.string())
            ns = pa.array(list(counts.values()), pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([words, ns], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in words_of(doc_id, text.as_py() or "", least_letters).items():
                    counts[word] += n
                if len(counts) > KEPT_WORDS:
                    yield handed_on()
        yield handed_on()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("text").cast("string").alias("text")).mapInArrow(
        emit, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbol(letter: str, symbols: int) -> str:
    """A letter's symbol; letters that follow one another are spread evenly."""
    return chr(0x61 + (ord(letter) * 0x9E3779B1 >> 16) % symbols)


def neighbourhood(word: str, symbols: int) -> set[str]:
    """A reduced word and all strings over the symbols that are one edit from it."""
    alphabet = [chr(0x61 + i) for i in range(symbols)]
    found = {word}
    for i in range(len(word) + 1):
        head, tail = word[:i], word[i:]
        found.update(head + s + tail for s in alphabet)
        if tail:
            found.update(head + s + tail[1:] for s in alphabet)
            found.add(head + tail[1:])
    return found


def reduced(vocabulary: DataFrame, symbols: int = SYMBOLS, edits: bool = False) -> DataFrame:
    """(reduced, word, n) of every word, or with ``edits`` of its whole neighbourhood."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ns = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            table = {ord(x): symbol(x, symbols) for x in set("".join(words))}
            for first in range(0, len(words), 500):
                keys = [[short] if not edits else list(neighbourhood(short, symbols))
                        for short in (w.translate(table) for w in words[first:first + 500])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for some in keys for k in some], pa.string()),
                     pa.array([w for w, some in zip(words[first:], keys) for _ in some],
                              pa.string()),
                     pa.array([n for n, some in zip(ns[first:], keys) for _ in some],
                              pa.int64())], names=["reduced", "word", "n"])

    return vocabulary.mapInArrow(emit, _KEY)


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): every word with every word one edit from it."""
    other = reduced(vocabulary, symbols).select(
        "reduced", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # A word becomes more than a hundred rows: by its bytes Spark would see few tasks.
    tasks = -(-vocabulary.count() // TASK_WORDS) or 1
    met = reduced(vocabulary.repartition(tasks), symbols, edits=True).join(other, "reduced")
    return met.where(F.levenshtein("word", "near", 1) == 1).drop("reduced")


def lead_to_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by doubling the steps taken.

    A form is at least ``FACTOR`` times as frequent as its word, so there are no
    circles, and the number of rounds grows as the logarithm of a chain.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")


def variants(docs: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word that is frequent enough."""
    vocabulary = stored(word_counts(docs), "spelling-words")
    # Strings are ordered by their bytes, which is the order of code points.
    nearest = near_words(vocabulary, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("rank"), "near", "near_n")).alias("best"))
    found = stored(vocabulary.join(nearest, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.near_n") >= FACTOR * F.col("n"), F.col("best")).alias("best")).select(
        "word", "n", "n_near", F.col("best.near").alias("form"),
        F.col("best.near_n").alias("form_n")), "spelling-forms")
    roots = lead_to_roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
