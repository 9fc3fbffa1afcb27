"""Mixing sources to target weights, by hierarchical budgets.

Sources form a tree: domain, language, source. Every node has a target weight
among its siblings, and a capacity: the tokens below it times ``epochs``. The
budget flows down from the root. Siblings share their parent's budget by weight,
and what one of them cannot use goes to the others in the same proportion. As a
parent never gets more than its children can hold, a shortage is met among
siblings first and reaches the next level only when all of them are full.

Each leaf then takes a prefix of its documents in a seeded order: whole epochs
first, and of the last epoch, whose order has its own seed, the documents up to
the tokens left. A document takes part ``copies`` times.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Nulls in lang or source are leaves of
their own; a null text has no tokens, and documents without tokens are taken as
often as the full epochs of their leaf, and in its last epoch if they come
before the cut. Rows that are equal in doc_id, text, lang and source have one
place in the order and are taken together or not at all. An empty table gives no
rows.

Everything is DataFrame operations. A leaf that holds a third of all rows is cut
into ``BUCKETS`` ranges of its order: only sums of ranges meet in one place, and
rows are ordered one by one within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quizlens.llm.windows import NO_ID, free_names
from quizlens.session import stored

EPOCHS = 2       # times a document may be used at most
SHARE = 0.6      # budget, as a share of all tokens, if none is given
SEED = "mix-1"
#: Leading hex digits of the order hash that make a range: 16**3 ranges a leaf.
RANGE_DIGITS = 3
LEVELS = ("domain", "lang", "source")


def default_domain(source: Column) -> Column:
    """Sources whose number ends in 0, 3, 6 or 9 are books, other numbered ones are web."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.when(number == "", F.lit("other")).when(
        F.substring(number, -1, 1).isin("0", "3", "6", "9"), F.lit("books")).otherwise(
        F.lit("web"))


def default_weight(level: str) -> Column:
    """Weights of nodes among their siblings; a missing name has the weight 1."""
    if level == "domain":
        return F.when(F.col("domain") == "books", 3.0).otherwise(2.0)
    if level == "lang":
        return F.when(F.col("lang") == "en", 4.0).otherwise(2.0)
    return F.lit(1.0)


def shared(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``name``: the part of ``budget`` (of the parent) that each node gets.

    Filling siblings to one level per weight: in the order of capacity by
    weight, level i is what would be left for each weight if those before were
    full. The highest of these levels is the one that holds.
    """
    order = Window.partitionBy(*parent).orderBy(
        F.col("capacity") / F.col("weight"), F.col("node"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    all_of = Window.partitionBy(*parent)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum(
        "weight").over(after)
    return nodes.withColumn("level", level).withColumn(
        name, F.least(F.col("capacity").cast("double"),
                      F.max("level").over(all_of) * F.col("weight")))


def budgets(leaves: DataFrame, budget: Column, weight=default_weight) -> DataFrame:
    """Tokens granted to each leaf of ``leaves`` (domain, lang, source, tokens, capacity)."""
    leaves = leaves.withColumns({k: F.coalesce(k, F.lit("\x00")) for k in LEVELS})
    granted = None
    for depth in range(1, len(LEVELS) + 1):
        keys = list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        if granted is None:
            total = leaves.agg(F.sum("tokens").alias("all_tokens")).select(
                F.lit(0).alias("root"), budget.cast("double").alias("budget"))
            nodes = nodes.withColumn("root", F.lit(0)).join(F.broadcast(total), "root")
            parent = ["root"]
        else:
            parent = keys[:-1]
            nodes = nodes.join(granted, parent)
        nodes = nodes.withColumn("weight", weight(LEVELS[depth - 1])).withColumn(
            "node", F.col(keys[-1]))
        granted = shared(nodes, parent, "granted").select(
            *keys, F.col("granted").alias("budget"))
    return leaves.join(granted, list(LEVELS)).select(
        *LEVELS, "tokens", F.floor(F.round("budget", 4)).alias("granted"))


def mix(docs: DataFrame, budget: int | None = None, epochs: int = EPOCHS, seed: str = SEED,
        domain=default_domain, weight=default_weight) -> DataFrame:
    """doc_id, domain, lang, source, n_words, granted (of the leaf) and copies, for every
    row that takes part at least once; text_key tells rows of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("text_key"),
        domain(F.col("source")).alias("domain"),
        F.coalesce("lang", F.lit("\x00")).alias("lang"),
        F.coalesce("source", F.lit("\x00")).alias("source"), words.alias("n_words")), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_words").alias("tokens")).withColumn(
        "capacity", F.col("tokens") * epochs)
    total = F.floor(F.col("all_tokens") * SHARE) if budget is None else F.lit(budget)
    granted = budgets(leaves, total, weight).withColumns({
        "whole": F.when(F.col("tokens") > 0, F.floor(F.col("granted") / F.col("tokens")))
        .otherwise(0),
        "rest": F.when(F.col("tokens") > 0, F.col("granted") % F.col("tokens")).otherwise(0)})
    granted = stored(granted, "mix-granted")

    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"),
                             F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key"))
    dealt = stored(rows.join(granted, list(LEVELS)).withColumn("draw", draw).withColumn(
        "range", F.substring("draw", 1, RANGE_DIGITS)), "mix-dealt")
    leaf = list(LEVELS)
    sums = dealt.groupBy(*leaf, "range").agg(F.sum("n_words").alias("range_words"))
    up_to = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("before", F.coalesce(
        F.sum("range_words").over(up_to), F.lit(0))), "mix-sums")
    # Ranges that end within the rest are taken whole. Only those that hold the cut
    # are ordered row by row.
    placed = dealt.join(sums, [*leaf, "range"])
    inside = F.col("before") + F.col("range_words") <= F.col("rest")
    beyond = F.col("before") > F.col("rest")
    # Without a frame of rows, a sum takes in all rows of one place.
    row_order = Window.partitionBy(*leaf, "range").orderBy("draw", "doc_id", "text_key")
    columns = ["doc_id", "text_key", *leaf, "n_words", "granted"]
    clear = placed.where(inside | beyond).select(
        *columns, (F.col("whole") + inside.cast("long")).alias("copies"))
    cut = placed.where(~inside & ~beyond).withColumn(
        "upto", F.col("before") + F.sum("n_words").over(row_order))
    cut = cut.select(*columns, (F.col("whole") + (F.col("upto") <= F.col("rest")).cast("long"))
                     .alias("copies"))
    named = {k: F.when(F.col(k) != "\x00", F.col(k)) for k in ("lang", "source")}
    return clear.unionByName(cut).where("copies > 0").withColumns(named)


def draw(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as it takes part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d, t, l, s, copies, copy = names = free_names(docs, "_d", "_t", "_l", "_s", "_n", "_copy")
    keys = names[:4]
    chosen = stored(mix(docs, **settings).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias(d), F.col("text_key").alias(t),
        F.coalesce("lang", F.lit("\x00")).alias(l),
        F.coalesce("source", F.lit("\x00")).alias(s), F.col("copies").alias(copies)).distinct(),
        "mix-chosen")
    keyed = docs.withColumns({
        d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
        t: F.md5(text.cast("binary")), l: F.coalesce("lang", F.lit("\x00")),
        s: F.coalesce("source", F.lit("\x00"))})
    return keyed.join(chosen, keys).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
