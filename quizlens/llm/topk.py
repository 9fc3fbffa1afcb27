"""Exact top-k inner products in three phases with a uniform threshold.

The components of a vector are dealt to ``SLICES`` lists: a list holds, for each
query, the candidates' partial scores over its own components, and a score is
the sum over the lists.

1. Every list gives its ``k`` best candidates of a query, with their full scores.
   The k-th best of these is a safe cutoff, as k candidates reach it.
2. The cutoff goes back to the lists. A candidate that reaches the cutoff has a
   partial score of at least cutoff / SLICES in some list, so every list marks
   its entries from there on. Entries also carry what the other lists could add
   at most (by the norms of query and candidate there), which drops most of them.
3. Marked candidates are scored in full, once however many lists mark them, and
   the k best of each query are the answer.

All lists of a block of candidates lie side by side, so phases work in blocks: a
block of candidates against a block of queries, as matrix products. A block gives
no more than the best of its candidates for each query, whatever the lists mark.
Queries are blocks of bounded size that meet candidate blocks by an equi-join; no
block grows with the data. Equal vectors are one candidate that remembers its
``k + 1`` smallest ids: no other copy can be among a query's k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quizlens.operators.ordering import with_position
from quizlens.session import stored

K, SLICES = 5, 4
QUERY_BLOCK, BLOCK = 1024, 2048
EXACT = 2.0**53  # below this, sums of products in doubles are exact


def integers(embedding: Column) -> Column:
    """floor(256 * x) of every component, as doubles; null for vectors that take no part.

    Doubles hold these integers exactly.
    """
    numbers = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x) < F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        y = x * 256
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).when(
            F.abs(y) < float("inf"), y).otherwise(
            F.raise_error(F.lit("256 times a component does not fit a double")).cast("double"))

    return F.when(sound & (F.size(embedding) > 0), F.transform(numbers, whole))


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: v, ids (the k + 1 smallest) and c (a number of their own)."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn(
        "c", F.col("ids")[0])


def packed_blocks(rows: DataFrame, key: str, size: int, extra: str = "") -> DataFrame:
    """Blocks of at most ``size`` vectors as matrices: block, n, ids and m (doubles, row-major)."""
    schema = "block long, n int, ids binary, m binary" + (", cutoffs binary" if extra else "")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length = {}
            for i, n in enumerate(batch.column("v").value_lengths().to_pylist()):
                by_length.setdefault(n, []).append(i)
            for n, where in by_length.items():
                for first in range(0, len(where), size):
                    part = batch.take(pa.array(where[first:first + size]))
                    ids = part.column(key).to_numpy().astype(np.int64)
                    m = part.column("v").flatten().to_numpy().astype(np.float64)
                    row = {"block": int(ids[0]), "n": n, "ids": ids.tobytes(), "m": m.tobytes()}
                    if extra:
                        row["cutoffs"] = part.column(extra).to_numpy().astype(
                            np.float64).tobytes()
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema(
                        [("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()),
                         ("m", pa.binary())] + ([("cutoffs", pa.binary())] if extra else [])))

    return rows.select(key, "v", *([extra] if extra else [])).mapInArrow(emit, schema)


def met(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every candidate block with every query block of the same vector length."""
    queries = with_position(queries.withColumnsRenamed(
        {"block": "q_block", "ids": "q_ids", "m": "q_m"}), ["n", "q_block"], "place")
    queries = stored(queries, "topk-queries")
    # The blocks of one length have numbers in a row; a candidate block counts them off.
    numbers = queries.groupBy("n").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    pairs = blocks.join(numbers, "n").withColumn(
        "place", F.explode(F.sequence("low", "high"))).drop("low", "high")
    return pairs.join(queries, ["n", "place"])


def exact(q: np.ndarray, m: np.ndarray, row: np.ndarray, col: np.ndarray, total: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the pairs (row, col), and which of them lie below the longs.

    ``total`` has the sums in doubles, which are exact where they are small. A score
    above the longs raises, as the best score of its query would not fit.
    """
    limit = 1 << 63
    top = np.abs(q).max(1)[row] * np.abs(m).max(1)[col] * q.shape[1]
    scores = np.where(top < EXACT, total, 0).astype(np.int64)
    low = np.zeros(len(row), bool)
    for i in np.flatnonzero(~(top < EXACT)).tolist():
        score = sum(int(x) * int(y) for x, y in zip(q[row[i]].tolist(), m[col[i]].tolist()))
        if score >= limit:
            raise OverflowError(f"op2: a score of {score} does not fit a long")
        low[i] = score < -limit
        scores[i] = max(score, -limit)
    return scores, low


def best_of(row: np.ndarray, col: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best scores of every row; ties go to the smaller col."""
    order = np.lexsort((col, ~scores, row))
    first = np.searchsorted(row[order], row[order])
    return order[np.arange(len(order)) - first < n]


def entries(pairs: DataFrame, k: int, slices: int) -> DataFrame:
    """(query_id, c, list, part, score, low) of the candidates that blocks give.

    Without ``cutoffs`` in ``pairs``: for every list the k + 1 best of it, as one of
    them may be the query itself. With them: the k + 1 best scores among the
    candidates that the lists mark, as list 0.
    """
    second = "cutoffs" in pairs.columns

    def marked(q, m, cuts, parts, cutoff):
        """Candidates that some list holds from its share of the cutoff on."""
        q_norm = np.stack([np.sqrt((q[:, c]**2).sum(1)) for c in cuts])
        m_norm = np.stack([np.sqrt((m[:, c]**2).sum(1)) for c in cuts])
        # Rounding can only mark a candidate too many.
        slack = (1e-9 * (np.abs(cutoff) + 1))[:, None]
        wide = np.outer(np.sqrt((q_norm**2).sum(0)), np.sqrt((m_norm**2).sum(0)))
        if wide.max(initial=0) * q.shape[1] >= EXACT:
            slack = slack + 1e-15 * (q.shape[1] + 8) * wide
        cut = np.where(np.isfinite(cutoff), cutoff, -np.inf)[:, None]
        found = np.zeros((len(q), len(m)), bool)
        for s, part in enumerate(parts):
            rest = np.delete(np.arange(len(cuts)), s)
            most = part + q_norm[rest].T @ m_norm[rest]
            found |= ~(part < cut / len(cuts) - slack) & ~(most < cut - slack)
        return np.nonzero(found)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.to_pylist():
                q_ids, ids = (np.frombuffer(at[c], np.int64) for c in ("q_ids", "ids"))
                q = np.frombuffer(at["q_m"], np.float64).reshape(len(q_ids), -1)
                m = np.frombuffer(at["m"], np.float64).reshape(len(ids), -1)
                cuts = np.array_split(np.arange(q.shape[1]), min(slices, q.shape[1]))
                parts = [q[:, c] @ m[:, c].T for c in cuts]
                total = sum(parts)
                if second:
                    cutoff = np.frombuffer(at["cutoffs"], np.float64)
                    yield from given(q, m, q_ids, ids, total, 0, total, *marked(
                        q, m, cuts, parts, cutoff))
                    continue
                for s, part in enumerate(parts):
                    best = np.argpartition(-part, min(k, len(ids) - 1), axis=1)[:, :k + 1]
                    row = np.repeat(np.arange(len(q_ids)), best.shape[1])
                    yield from given(q, m, q_ids, ids, total, s, part, row, best.ravel())

    def given(q, m, q_ids, ids, total, s, part, row, col):
        if not len(row):
            return
        scores, low = exact(q, m, row, col, total[row, col])
        if second:
            # Candidates are in the order of c, so that ties go to the smaller one.
            keep = best_of(row, np.argsort(np.argsort(ids))[col], scores, k + 1)
            row, col, scores, low = row[keep], col[keep], scores[keep], low[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_ids[row]), pa.array(ids[col]), pa.array(np.full(len(row), s)),
             pa.array(part[row, col]), pa.array(scores), pa.array(low)],
            names=["query_id", "c", "list", "part", "score", "low"])

    return pairs.mapInArrow(
        emit, "query_id long, c long, list long, part double, score long, low boolean")


def others(scored: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """query_id, vec_id, score, low and rank of the ``n`` best scores of each query, for
    all ids that a candidate stands for but the query's own."""
    by = [F.desc("score"), "low"]
    first = Window.partitionBy("query_id").orderBy(*by, "c")
    few = scored.select("query_id", "c", "score", "low").withColumn(
        "rank", F.row_number().over(first)).where(F.col("rank") <= n + 1)
    ids = few.join(vectors.select("c", "ids"), "c").select(
        "query_id", "score", "low", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy(*by, "vec_id")
    return ids.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n)


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, slices: int = SLICES,
          block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k best other rows.

    Queries are the rows of ``embeddings`` (vec_id, embedding) for whose vec_id
    ``is_query`` holds. Ties go to the smaller vec_id. Vectors that are null or
    empty, or hold a null or non-finite component, take no part, nor do rows without
    vec_id; only vectors of equal length are compared. Finite components of any
    size take part, and a result that does not fit a long raises. A vec_id has one
    vector: the smallest, if rows repeat it.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                             integers(F.col("embedding")).alias("v")).where(
        "v is not null and vec_id is not null")
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-rows")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    vectors = stored(candidates(rows, k), "topk-vectors")
    blocks = stored(packed_blocks(vectors, "c", block), "topk-blocks")

    lists = entries(met(packed_blocks(queries, "query_id", query_block), blocks), k, slices)
    order = Window.partitionBy("query_id", "list").orderBy(F.desc("part"), "c")
    seen = lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    seen = seen.select("query_id", "c", "score", "low").distinct()
    cutoff = others(seen, vectors, k).groupBy("query_id").agg(
        F.when((F.count(F.lit(1)) == k) & ~F.max("low"), F.min("score")).alias("cutoff"))
    # Without k candidates there is no cutoff, and every candidate counts.
    asked = stored(queries.join(cutoff, "query_id", "left").withColumn(
        "cutoff", F.coalesce(F.col("cutoff").cast("double"), F.lit(float("-inf")))), "topk-cutoff")

    found = entries(met(packed_blocks(asked, "query_id", query_block, "cutoff"), blocks), k, slices)
    return others(found, vectors, k).select(
        "query_id", "rank", "vec_id", F.when(~F.col("low"), F.col("score")).otherwise(
            F.raise_error(F.lit("op2: a score does not fit a long")).cast("long")).alias("score"))
