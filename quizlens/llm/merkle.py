"""A Merkle manifest of a table: one root that changes with any row.

The rows of each source are the leaves of a tree, in the order of doc_id. Every
level is one equijoin of its nodes with themselves: a node meets the nodes of its
run whose slot is its own shifted by 1, 2, ... (with two slots that is its index
XOR 1), and the nodes in slot zero emit their parents.
The roots of the sources are the leaves of a tree above them. Proofs are put
together downwards: what a level's nodes have beside them, and then the proof of
their parent.

Nodes of a run lie together and a run is bounded, so a source with any share of
the rows is spread over all tasks, and a level moves its nodes once. The number
of levels is the logarithm of the largest source; beside it nothing passes the
driver.

A null is written ``-``; a null source is a source of its own, before all others.
Null doc_ids come first; rows of equal doc_id follow their hash, and equal rows
are leaves each. Long texts are hashed whole. Extra columns are ignored. A table
without rows has no root, and all results are empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quizlens.operators.ordering import with_position
from quizlens.session import stored

# Fixed values of the contract: the columns of a leaf and the nodes of a run.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
TAMPER_EVERY = 5

_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (0x41, 0x61))
_STEPS = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_of(fields: dict[str, Column]) -> Column:
    """The hash of a row: every value after its length in bytes."""
    parts = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                                F.lit("-")))
    return F.unhex(hashed(*parts))


def tampered_leaf() -> Column:
    """The leaf after a change that hits every fifth doc_id: A-Z of its text in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    changed = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    return F.when(hit, leaf_of({"text": changed}))


@dataclass
class Tree:
    """Nodes of many trees, level by level: tree, run, slot, n (nodes of the level) and digest.

    ``levels`` are stored tables; a level has the nodes of all trees that reach it,
    and a tree's root is its only node of the last level that it reaches.
    """

    levels: list[DataFrame]
    fan: int

    def roots(self) -> DataFrame:
        """(tree, digest), one row per tree."""
        found = [level.where("n = 1").select("tree", "digest") for level in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def beside(nodes: DataFrame, fan: int, *carried: str) -> DataFrame:
    """Every node with what the other slots of its run hold, in their order.

    The siblings are the nodes of the same run at a shift of 1 to fan - 1. The keys are
    tree and run alone, by which the nodes lie together: with the slot among them Spark
    would deal out every pair anew.
    """
    here = nodes.repartition("tree", "run")
    shifted = here.select(F.col("tree").alias("_tree"), F.col("run").alias("_run"),
                          F.col("slot").alias("other"), F.col("digest").alias("other_digest"))
    shift = F.pmod(F.col("other") - F.col("slot"), F.lit(fan))
    met = here.join(shifted, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run"))
                    & shift.between(1, fan - 1), "left")
    return met.groupBy("tree", "run", "slot").agg(
        *[F.first(c).alias(c) for c in ("n", "digest", *carried)],
        F.array_sort(F.collect_list(F.when(F.col("other_digest").isNotNull(), F.struct(
            "other", "other_digest")))).alias("others"))


def joined(others: Column) -> Column:
    return F.array_join(F.transform(others, lambda x: hex_of(x["other_digest"])), "")


def grown(leaves: DataFrame, largest: int, fan: int = FAN) -> Tree:
    """All levels over ``leaves`` (tree, run, slot, n, digest); ``largest`` is their greatest n."""
    levels = [leaves]
    while largest > 1:
        slot_zero = beside(levels[-1].where("n > 1").select(
            "tree", "run", "slot", "n", "digest"), fan).where("slot = 0")
        n = F.ceil(F.col("n") / fan).cast("long")
        levels.append(stored(slot_zero.select(
            "tree", F.expr(f"run div {fan}").alias("run"),
            (F.col("run") % fan).cast("int").alias("slot"), n.alias("n"),
            F.unhex(hashed(hex_of(F.col("digest")), joined(F.col("others")))).alias("digest")),
            "merkle-level"))
        largest = -(-largest // fan)
    return Tree(levels, fan)


def places(rows: DataFrame, order: list[str], fan: int) -> tuple[DataFrame, int]:
    """``rows`` of many trees with run, slot and n by their order, and the greatest n."""
    rows = stored(rows, "merkle-rows")  # sorting samples them first
    placed = stored(with_position(rows, ["tree", *order], "place"), "merkle-placed")
    sizes = stored(placed.groupBy("tree").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-sizes")
    index = F.col("place") - F.col("first")
    nodes = stored(placed.join(sizes, "tree").withColumn("index", index).select(
        *rows.columns, F.expr(f"index div {fan}").alias("run"),
        (F.col("index") % fan).cast("int").alias("slot"), "n"), "merkle-leaves")
    return nodes, sizes.agg(F.max("n")).first()[0] or 0


def proofs(tree: Tree, above: DataFrame, *carried: str) -> DataFrame:
    """The leaves with ``carried`` columns, what ``above`` says of their tree, and their proof.

    ``above`` has tree, top (a struct) and steps, the proof of the tree's root.
    ``steps`` holds what stands left and right of the node on every level.
    """
    upper = None
    for height, level in reversed(list(enumerate(tree.levels))):
        extra = () if height else carried
        index = F.col("run") * tree.fan + F.col("slot")
        own = level.where("n = 1").join(above, "tree").select(
            "tree", index.alias("index"), "digest", *extra, "top", "steps")
        if upper is not None:
            step = F.struct(
                joined(F.filter("others", lambda x: x["other"] < F.col("slot"))).alias("left"),
                joined(F.filter("others", lambda x: x["other"] > F.col("slot"))).alias("right"))
            below = beside(level.where("n > 1"), tree.fan, *extra).join(
                upper.select("tree", F.col("index").alias("run"), "top",
                             F.col("steps").alias("further")), ["tree", "run"])
            own = own.unionByName(below.select(
                "tree", index.alias("index"), "digest", *extra, "top",
                F.concat(F.array(step), "further").cast(_STEPS).alias("steps")))
        upper = stored(own, "merkle-proofs") if height else own
    return upper


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, hex_of(digest), lambda at, step: hashed(
        step["left"], at, step["right"]))


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Every row's leaf, its tree's root, the root of all, and its proof.

    doc_id, digest and tampered (leaves as bytes), top (subroot and root in hex)
    and steps.
    """
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf_of({}).alias("digest"),
        tampered_leaf().alias("tampered"))
    leaves, largest = places(rows, ["doc_id", "digest"], fan)
    sources = grown(leaves, largest, fan)

    subroots = sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source"),
                                      "digest")
    tops, n_sources = places(subroots, ["source"], fan)
    crown = grown(tops, n_sources, fan)
    root = stored(crown.roots().select("tree", F.struct(hex_of(F.col("digest")).alias("root"))
                                       .alias("top"), F.array().cast(_STEPS).alias("steps")),
                  "merkle-root")
    above = stored(proofs(crown, root, "source").select(
        F.col("source").alias("tree"),
        F.struct(hex_of(F.col("digest")).alias("subroot"), "top.root").alias("top"), "steps"),
        "merkle-tops")
    return proofs(sources, above, "doc_id", "tampered")


def verify(proved: DataFrame) -> DataFrame:
    """Fold every leaf of ``manifest``, changed where it was tampered with, up to the root."""
    return proved.select(
        "doc_id", hex_of(F.col("digest")).alias("leaf"), "top.subroot", "top.root",
        F.sha2(F.array_join(F.transform("steps", lambda x: F.concat(x["left"], x["right"])), ""),
               256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("steps")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
