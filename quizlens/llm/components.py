"""Connected components by repeated contraction; all steps are grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quizlens.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(x, root) for every x of ``edges`` (u, v): the smallest x it is linked with.

    In each round every node moves to its smallest neighbour, and edges follow.
    A star is done in two rounds, a chain in about as many as its logarithm. A
    node with very many edges is combined before each shuffle, and joins are
    between stored tables, so that adaptive execution can split it.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"),
                                                           F.col("u").alias("v")))
    edges = stored(both.where("u <> v").distinct(), "cc-edges")
    labels = stored(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("root"))
                    .select(F.col("u").alias("x"), "root"), "cc-labels")
    moves = labels
    while not edges.isEmpty():
        to = moves.select(F.col("x").alias("v"), F.col("root").alias("v2"))
        half = stored(edges.join(to, "v").select("u", F.col("v2").alias("v")).distinct(),
                      "cc-half")
        back = moves.select(F.col("x").alias("u"), F.col("root").alias("u2"))
        edges = stored(half.join(back, "u").select(F.col("u2").alias("u"), "v")
                       .where("u <> v").distinct(), "cc-edges")
        moves = stored(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("root"))
                       .select(F.col("u").alias("x"), "root"), "cc-moves")
        step = moves.select(F.col("x").alias("root"), F.col("root").alias("next"))
        labels = stored(labels.join(step, "root", "left")
                        .select("x", F.coalesce("next", "root").alias("root")), "cc-labels")
    return labels
