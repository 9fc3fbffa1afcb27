"""Exact counts of tokens by document length.

One aggregation to the histogram of encoded lengths answers everything: suffix
sums over it give, for every context limit, the documents and tokens that fit,
the tokens left when longer texts are truncated, and any quantile. The
histogram has a row per distinct length, however many documents there are.

Null and empty texts have length 0. Repeated rows count each time. Without
documents all tables are empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quizlens.llm.codes import pieces
from quizlens.llm.encoding import PIECE_BYTES, TOKENIZER, encoder_of
from quizlens.llm.windows import as_batch
from quizlens.session import stored

QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def encoded_lengths(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """n_tokens of every row; nothing but the texts travels to Python."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text"), PIECE_BYTES):
                yield as_batch("n_tokens long", encoder.lengths(data, offsets))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        emit, "n_tokens long")


def histogram(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """n_tokens and n_docs, one row per length that occurs."""
    return encoded_lengths(docs, tokenizer).groupBy("n_tokens").agg(
        F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """What every length that occurs would do as a context limit.

    n_tokens (the limit), n_docs (of that very length), docs_within and
    tokens_within (that long or shorter), docs_over, truncated_tokens (of all
    documents when each is cut at the limit) and lost_tokens. Between two rows
    truncated_tokens is linear: it grows by docs_over for each token more.
    """
    hist = stored(hist, "lengths")  # read twice below; the texts are encoded once
    # Lengths are grouped by bits, so that no window sees more than 4096 rows:
    # sums over the groups first, then within each group.
    group = F.shiftright("n_tokens", 12)
    of_group = hist.groupBy(group.alias("g")).agg(
        F.sum("n_docs").alias("gd"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("gt"))
    over = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    of_group = of_group.select(
        "g", F.coalesce(F.sum("gd").over(over), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("gt").over(over), F.lit(0)).alias("t_after"),
        F.sum("gd").over(all_rows).alias("all_docs"),
        F.sum("gt").over(all_rows).alias("all_tokens"))
    within = Window.partitionBy("g").orderBy(F.desc("n_tokens")).rowsBetween(
        Window.unboundedPreceding, -1)
    suffix = hist.withColumn("g", group).join(of_group, "g").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.col("d_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_over"),
        (F.col("t_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within),
                                       F.lit(0))).alias("tokens_over"))
    kept = F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return suffix.select(
        "n_tokens", "n_docs", (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_within"), "docs_over",
        kept.alias("truncated_tokens"), (F.col("all_tokens") - kept).alias("lost_tokens"))


def at_limits(table: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Totals for any context limits, from ``limits``: the next length below decides."""
    first = table.agg(F.max(F.col("docs_within") + F.col("docs_over")).alias("all_docs"))
    asked = F.explode(F.array(*[F.lit(int(w)).cast("long") for w in wanted]))
    picked = table.select(asked.alias("limit"), F.struct(table.columns).alias("row")).where(
        "row.n_tokens <= limit").groupBy("limit").agg(
        F.max_by("row", "row.n_tokens").alias("row"))
    grown = F.col("row.docs_over") * (F.col("limit") - F.col("row.n_tokens"))
    # Below the shortest document each one is cut to the limit.
    every = first.where("all_docs is not null").select(asked.alias("limit"), "all_docs")
    return every.join(picked, "limit", "left").select(
        "limit", F.coalesce("row.docs_within", F.lit(0)).alias("docs_within"),
        F.coalesce("row.docs_over", "all_docs").alias("docs_over"),
        F.coalesce(F.col("row.truncated_tokens") + grown,
                   F.col("all_docs") * F.col("limit")).alias("truncated_tokens"))


def quantiles(table: DataFrame, wanted: Sequence[float] = QUANTILES) -> DataFrame:
    """The smallest length that at least that share of documents does not exceed."""
    asked = F.explode(F.array(*[F.lit(float(w)) for w in wanted]))
    share = F.col("docs_within") / (F.col("docs_within") + F.col("docs_over"))
    return table.select(asked.alias("quantile"), "n_tokens", share.alias("share")).where(
        "share >= quantile").groupBy("quantile").agg(F.min("n_tokens").alias("n_tokens"))


def with_quantiles(table: DataFrame, wanted: Sequence[float] = QUANTILES) -> DataFrame:
    """``limits`` with ``quantiles``: those of ``wanted`` that a length is the answer to."""
    all_docs = F.col("docs_within") + F.col("docs_over")
    upto, before = F.col("docs_within") / all_docs, (F.col("docs_within") - F.col("n_docs")) / all_docs
    return table.withColumn("quantiles", F.filter(
        F.array(*[F.lit(float(w)) for w in wanted]), lambda q: (q <= upto) & (q > before)))
