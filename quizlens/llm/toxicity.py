"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over the words that occur in a text. It is trained on labelled
texts, and for each of them that names a group of people also on its
counterfactual: the same text with the group's name swapped for another of its
kind. The loss adds the squared change of the score's logit between the two, so
that naming a group does not move a score, and neutral mentions stay neutral.

Only the fit is on a sample: at most ``SAMPLE`` labelled rows, those with the
smallest hash of their id (all, if there are fewer). The vocabulary is what
``MIN_DOCS`` of them contain. Every document is scored over its whole text.

Labels, lang, source and doc_id are no inputs of a score. Rows without a label
of 0 or 1, or without a document, are not learned from; several labels of one
document count each, and of documents that repeat an id one counts. Without any usable label every score is 0. Null and empty
texts get the score of a text without known words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quizlens.llm.codes import PUNCTUATION, CodeSet, Words, pieces
from quizlens.llm.sending import received, sent
from quizlens.llm.windows import as_batch
from quizlens.session import stored

SAMPLE = 20_000
MIN_DOCS = 4
FOLDS, HELD_OUT = 5, 0
EVIDENCE = 4.0        # standard errors by which a word must tell the classes apart
RIDGE = 0.4           # weight of squared weights, shared by the rows
FAIRNESS = 1.0        # weight of squared logit changes under a swap
STEPS = 250
RATE = 0.1

# Names of groups; a name is swapped for the next of its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("female", "male"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "native"), ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"), ("immigrants", "citizens"), ("old", "young"),
    ("disabled", "abled"), ("mujeres", "hombres"), ("frauen", "männer"), ("femmes", "hommes"),
)


def word_codes(texts: list[str]) -> np.ndarray:
    """Codes of single words."""
    (_, _, data, offsets), = pieces(pa.array(texts, pa.string()), 1 << 30)
    return Words(data, offsets, lower=True, separators=PUNCTUATION).codes()


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts of a piece, and the text of each."""
    words = Words(data, offsets, lower=True, separators=PUNCTUATION)
    return words.codes(), words.rows()


@dataclass
class Model:
    """Weights of word codes (sorted) and the bias; ``fitted`` is false without labels."""
    codes: np.ndarray
    weights: np.ndarray
    bias: float
    fitted: bool = True

    def score(self, data: np.ndarray, offsets: np.ndarray, index: CodeSet) -> np.ndarray:
        n = len(offsets) - 1
        if not self.fitted:
            return np.zeros(n)
        codes, row = text_features(data, offsets)
        at, word = index.find(codes)
        pairs = np.unique(row[at] * len(self.codes) + word) if len(at) else at
        logit = self.bias + np.bincount(
            pairs // max(1, len(self.codes)), self.weights[pairs % max(1, len(self.codes))], n)[:n]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def swaps() -> dict[int, int]:
    """The code of every group's name, and the code of the name it is swapped for."""
    return {int(c): int(t) for group in IDENTITY_TERMS
            for c, t in zip(word_codes(list(group)), word_codes(list(group[1:] + group[:1])))}


def group_names() -> np.ndarray:
    terms = swaps()
    return np.array(sorted({*terms, *terms.values()}), np.uint64)


def telling(count: np.ndarray, toxic: np.ndarray, rate: float, min_docs: int) -> np.ndarray:
    """Which words, in ``count`` texts and ``toxic`` toxic ones, are learned.

    Words whose share among toxic texts differs from that among the others by chance
    alone would only be learned by heart.
    """
    spread = np.sqrt(np.maximum(count * rate * (1 - rate), 1e-9))
    return (count >= min_docs) & (np.abs(toxic - count * rate) >= EVIDENCE * spread)


def fit(labels: np.ndarray, row: np.ndarray, codes: np.ndarray, min_docs: int = MIN_DOCS,
        **settings) -> Model:
    """Fit to rows with ``labels``; ``codes`` are distinct words of each ``row``."""
    if not len(labels):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, False)
    unique, column, count = np.unique(codes, return_inverse=True, return_counts=True)
    keep = telling(count, np.bincount(column, labels[row], len(unique)), labels.mean(), min_docs)
    vocabulary = np.union1d(unique[keep], group_names())
    index = CodeSet(vocabulary)
    at, feature = index.find(codes)
    return learned(labels, row[at], feature, vocabulary, **settings)


def learned(labels: np.ndarray, row: np.ndarray, feature: np.ndarray, vocabulary: np.ndarray,
            fairness: float = FAIRNESS, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """Weights of ``vocabulary``, from places in it that each ``row`` has."""
    n, terms = len(labels), swaps()
    # A swap takes one word from a text and puts another there.
    target = np.full(len(vocabulary), -1)
    target[np.searchsorted(vocabulary, np.array(list(terms), np.uint64))] = np.searchsorted(
        vocabulary, np.array(list(terms.values()), np.uint64))
    swapped = target[feature] >= 0
    swap_row, swap_from = row[swapped], feature[swapped]
    swap_to = target[swap_from]
    # Log-odds are learned by Adam on the whole sample; both classes weigh the same.
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / n
    weights, bias = np.zeros(len(vocabulary)), 0.0
    first, second = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    for step in range(1, steps + 1):
        logit = bias + np.bincount(row, weights[feature], n)
        error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - labels) * importance
        slope = np.bincount(feature, error[row], len(vocabulary)) + 2 * ridge / n * weights
        if len(swap_row):
            change = np.bincount(swap_row, weights[swap_to] - weights[swap_from], n)
            push = 2 * fairness / n * change[swap_row]
            slope += np.bincount(swap_to, push, len(vocabulary))
            slope -= np.bincount(swap_from, push, len(vocabulary))
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return Model(vocabulary, weights, float(bias))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS


def sampled_words(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """toxic and the distinct word codes of at most ``sample`` labelled texts, stored.

    Of documents that repeat an id the one with the smallest hash of its text counts,
    so the sample is bounded in texts too.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    # The order by hash is that of a random sample; the limit is its documented bound.
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    chosen = stored(chosen.groupBy("doc_id").agg(F.collect_list("toxic").alias("marks")),
                    "toxicity-sample")
    schema = "doc_id long, t long, marks array<int>, codes binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                codes, row = text_features(data, offsets)
                bounds = np.searchsorted(row, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(low, high - low) for n in ("doc_id", "t", "marks")),
                     pa.array([np.unique(codes[a:b]).tobytes()
                               for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["doc_id", "t", "marks", "codes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = texts.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", F.xxhash64("text").alias("t"), "marks", "text").mapInArrow(emit, schema)
    one = words.groupBy("doc_id").agg(F.min(F.struct("t", "marks", "codes")).alias("one"))
    return stored(one.select(F.explode("one.marks").alias("toxic"), "one.codes"), "toxicity-words")


def vocabulary_of(words: DataFrame, rate: float, min_docs: int) -> np.ndarray:
    """Sorted codes of the words to be learned and of all names; counted in Spark."""
    schema = "code long, n long, toxic long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                codes = [np.frombuffer(b, np.uint64) for b in part.column("codes").to_pylist()]
                marks = np.repeat(part.column("toxic").to_numpy(), [len(c) for c in codes])
                unique, column = np.unique(np.concatenate(codes), return_inverse=True)
                yield as_batch(schema, unique, np.bincount(column, minlength=len(unique)),
                               np.bincount(column, marks, len(unique)).astype(np.int64))

    counts = words.mapInArrow(emit, schema).groupBy("code").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= min_docs)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["code"]).filter(pa.array(telling(
                batch.column("n").to_numpy(), batch.column("toxic").to_numpy(), rate, min_docs)))

    found = counts.mapInArrow(choose, "code long").toArrow()["code"].to_numpy()
    return np.union1d(found.view(np.uint64), group_names())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_docs: int = MIN_DOCS,
          **settings) -> Model:
    """Fit on rows of ``labels`` outside the held-out fold.

    The driver gets the words that are learned, of the sample's texts, as places in the
    vocabulary of four bytes each.
    """
    words = sampled_words(docs, labels, sample)
    rate = words.agg(F.avg("toxic")).first()[0]
    if rate is None:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, False)
    vocabulary = vocabulary_of(words, rate, min_docs)
    shared = sent(docs.sparkSession, vocabulary)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CodeSet(received(shared))
        for batch in batches:
            places = [index.find(np.frombuffer(b, np.uint64))[1].astype(np.int32).tobytes()
                      for b in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(places, pa.binary())], names=["toxic", "places"])

    # In an order of their own, so that sums do not depend on the order of tasks.
    table = words.mapInArrow(emit, "toxic int, places binary").toArrow().sort_by(
        [("places", "ascending"), ("toxic", "ascending")])
    shared.destroy()
    places = table["places"].combine_chunks()
    size = pc.binary_length(places).to_numpy() // 4
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    feature = np.frombuffer(b"".join(places.to_pylist()), np.int32)
    toxic = table["toxic"].to_numpy().astype(np.float64)
    return learned(toxic, row, feature, vocabulary, **settings)


def with_score(docs: DataFrame, model: Model, column: str = "_score") -> DataFrame:
    """All columns of ``docs`` and ``column``, a name that ``docs`` lacks."""
    used = np.flatnonzero(np.abs(model.weights) > 1e-6)
    model = Model(model.codes[used], model.weights[used], model.bias, model.fitted)
    shared = sent(docs.sparkSession, (model, CodeSet(model.codes)))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    kinds = inner.withColumn("_score", F.lit(0.0)).schema
    inner = inner.withColumn(
        "_text", F.coalesce(F.col(names[docs.columns.index("text")]).cast("string"), F.lit("")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, index = received(shared)
        for batch in batches:
            score = [model.score(data, offsets, index)
                     for _, _, data, offsets in pieces(batch.column("_text"))]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate(score) if score else [], pa.float64())],
                names=[*names, "_score"])

    return inner.mapInArrow(emit, kinds).toDF(*docs.columns, column)


def score(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = train(docs, labels, **settings)
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
