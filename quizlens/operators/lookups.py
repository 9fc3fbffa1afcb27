"""Joins to a table of single rows per key, with a checked key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quizlens.session import stored

def lookup(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
           values: Sequence[str], strict: bool = True) -> DataFrame:
    """Add ``values`` of the one ``dim`` row whose key equals the fact's key.

    Strict: a key with no row or several rows raises when the value is read.
    Otherwise a missing key gives null and one of several rows is taken.

    ``dim`` is stored with one row per key. So Spark knows its size, broadcasts
    it below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise;
    then adaptive execution can split a hot key, as both sides are plain scans.
    No rows of it pass the driver.
    """
    key, rows = "_lookup_key", "_lookup_rows"
    one_each = (
        dim.groupBy(F.col(dim_key).alias(key))
        .agg(F.count(F.lit(1)).alias(rows),
             F.min(F.struct(*[F.col(v) for v in values])).alias("_lookup"))
        .where(F.col(key).isNotNull())
    )
    side = stored(one_each, "lookup")
    joined = facts.join(side, F.col(fact_key) == F.col(key), "left")
    added = {v: F.col("_lookup")[v] for v in values}
    if strict:
        problem = F.concat(F.lit(f"expected one row for {dim_key} "),
                           F.coalesce(F.col(fact_key).cast("string"), F.lit("null")))
        added = {
            v: F.when(F.col(rows) == 1, value)
            .otherwise(F.raise_error(problem).cast(dim.schema[v].dataType))
            for v, value in added.items()
        }
    return joined.withColumns(added).drop(key, rows, "_lookup")
