"""Near-duplicate documents by a chosen-path similarity join.

A document is its set of shingles. A tree branches documents by minwise tokens:
a node at depth k holds those whose k smallest tokens, one under each of the
tree's first k hash functions, are the same. Two documents of similarity s stay
together for k branchings with probability s**k. Nodes of up to ``NODE``
documents are compared exhaustively; larger ones are compared with their
smallest document and branch on. Sixteen independent trees that start at depth
2 miss a pair at similarity 0.75 with probability 2e-6 where nodes are small.
Branching alone would lose pairs of large nodes, so documents of large nodes
that components have not made one meet again on their rarest shingles
(``rest``), which leaves no pair out.

Comparisons in nodes are on sketches (128 hashes) with a cut that a true pair
misses with probability 2e-6. Every link is then confirmed on the full sets.
Each document first tries the smallest document it looks like; after
components are known, all pairs that still cross components are tried as well.

Equal sets are one document from the start, so copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quizlens.llm.codes import CONTENT, GRAMS, Sums, Words, mix, pieces
from quizlens.llm.components import components
from quizlens.llm.sending import received, sent
from quizlens.llm.windows import NO_ID, as_batch, column_of, with_keys
from quizlens.session import stored

SHINGLE = 5
PERCENT = 75
TREES, DEPTH = 16, 8
LEVELS = (2, 3, 5, 8)
NODE = 32
#: Equal hashes out of 128 below which a pair is not confirmed: a pair of
#: similarity 0.75 has 96 on average, with a standard deviation of 4.9.
ALIKE = 74
ROW_BITS = 12
#: Shingles are ordered by counts in so many buckets; pairs in a node of ``rest``
#: with more than BLOCK documents are compared in cells of two blocks.
BUCKET_BITS = 20
PAIR_BITS = 18
BLOCK = 256

_SIGNATURE = "d long, t long, n long, s1 long, s2 long, signature binary, sketch binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (52-bit codes) of all texts of a piece, and each text's bounds.

    A text with fewer words than a shingle has its whole sequence as its one shingle.
    """
    words = Words(data, offsets, lower=True)
    bounds, n = words.bounds, np.diff(words.bounds)
    sums = Sums(words.codes(), CONTENT)
    row = words.rows()
    first = np.flatnonzero(np.arange(len(row)) + SHINGLE <= bounds[1:][row]) if len(row) else row
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    codes = np.concatenate([sums.of(first, first + SHINGLE),
                            sums.of(bounds[short], bounds[short + 1])])
    row = np.concatenate([row[first], short]).astype(np.uint64)
    keys = np.sort(codes >> np.uint64(ROW_BITS) | row << np.uint64(64 - ROW_BITS))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    limits = np.arange(len(n) + 1, dtype=np.uint64)
    at = np.searchsorted(keys >> np.uint64(64 - ROW_BITS), limits)
    return keys & np.uint64((1 << (64 - ROW_BITS)) - 1), at


def few_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of fewer than 2**ROW_BITS rows."""
    step = (1 << ROW_BITS) - 1
    for start in range(0, len(column), step):
        for low, high, data, offsets in pieces(column.slice(start, step)):
            yield start + low, start + high, data, offsets


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set hash, 128 minwise tokens and sketch of ``with_keys`` documents."""
    factors = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = column_of(batch, "d"), column_of(batch, "t")
            for low, high, data, offsets in few_rows(batch.column("text")):
                codes, at = shingle_sets(data, offsets)
                n = np.diff(at)
                full = np.flatnonzero(n)
                tokens = np.full((high - low, len(factors)), 0xFFFFFFFF, np.uint32)
                sums = np.zeros((2, high - low), np.uint64)
                if len(full):
                    starts = at[:-1][full]
                    for i, salt in enumerate((0x51, 0xA7)):
                        sums[i, full] = np.add.reduceat(
                            mix(codes * np.uint64(256) + np.uint64(salt)), starts)
                    mixed = mix(codes)
                    for i, factor in enumerate(factors):
                        tokens[full, i] = np.minimum.reduceat(
                            (mixed * factor) >> np.uint64(32), starts)
                yield as_batch(
                    _SIGNATURE, d[low:high], t[low:high], n, sums[0], sums[1],
                    pa.array([row.tobytes() for row in tokens], pa.binary()),
                    pa.array([row.tobytes() for row in tokens.astype(np.uint8)], pa.binary()))

    return docs.select("d", "t", "text").mapInArrow(emit, _SIGNATURE)


def nodes(members: DataFrame, depth: int) -> DataFrame:
    """(tree, node, x) of documents (x, signature [, tree]) at a depth of all or one tree."""
    def key(tree):
        part = F.expr(f"substring(signature, {tree} * {4 * DEPTH} + 1, {4 * depth})")
        return F.xxhash64(F.lit(depth), F.expr(tree), part)

    if "tree" in members.columns:
        return members.select("tree", key("tree").alias("node"), "x")
    trees = F.array(*[F.struct(F.lit(i).alias("tree"), key(str(i)).alias("node"))
                      for i in range(TREES)])
    return members.select("x", F.explode(trees).alias("at")).select("at.tree", "at.node", "x")


def grow(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, x) of all nodes that are compared exhaustively; (x, leader) of the
    others; (node, x) of the large nodes that trees start with."""
    small, stars, start, members = None, None, None, sets.select("x", "signature")
    for depth in LEVELS:
        level = stored(nodes(members, depth), f"path-level{depth}")
        sizes = stored(level.groupBy("node").agg(F.count(F.lit(1)).alias("n"),
                                                 F.min("x").alias("leader")).where("n > 1"),
                       f"path-sizes{depth}")
        leaf = level.join(sizes.where(F.col("n") <= NODE), "node").select("node", "x")
        large = stored(level.join(sizes.where(F.col("n") > NODE), "node")
                       .select("tree", "node", "x", "leader"), f"path-large{depth}")
        start = large.select("node", "x") if start is None else start
        star = large.select("x", "leader").where("x <> leader")
        small = leaf if small is None else small.unionByName(leaf)
        stars = star if stars is None else stars.unionByName(star)
        if large.isEmpty():
            break
        members = large.select("tree", "x").join(sets.select("x", "signature"), "x")
    return stored(small, "path-small"), stored(stars.distinct(), "path-stars"), start


def alike_in_nodes(rows: DataFrame, all_pairs: bool) -> DataFrame:
    """Pairs (u, v), u smaller, that look alike in a node of ``rows`` (node, x, root, sketch).

    Only pairs of different roots count. Without ``all_pairs`` each document
    gets the smallest one it looks like in the node. If ``rows`` have n and left
    (``prefixes``), pairs that cannot share enough from there on do not count.
    """
    schema = "d1 long, t1 long, d2 long, t2 long"
    sized = "left" in rows.columns

    def compare(d, t, root_d, root_t, sketch, size, n=None, left=None):
        shape = (-1, size)
        block = sketch.reshape(-1, size, sketch.shape[1])
        alike = np.stack([(block == block[:, [i]]).sum(2, dtype=np.uint8) >= ALIKE
                          for i in range(size)], 1)
        rd, rt = root_d.reshape(shape), root_t.reshape(shape)
        alike &= (rd[:, :, None] != rd[:, None]) | (rt[:, :, None] != rt[:, None])
        alike &= np.tri(size, k=-1, dtype=bool)
        if sized:
            n, left = n.reshape(shape), left.reshape(shape)
            alike &= ((100 + PERCENT) * np.minimum(left[:, :, None], left[:, None])
                      >= PERCENT * (n[:, :, None] + n[:, None]))
        if not all_pairs:
            alike &= np.cumsum(alike, 2) == 1
        group, i, j = np.nonzero(alike)
        d, t = d.reshape(shape), t.reshape(shape)
        return d[group, j], t[group, j], d[group, i], t[group, i]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            node = table["node"].to_numpy()
            cut = int(np.searchsorted(node, node[-1])) if len(node) else 0
            kept = table.slice(cut)
            yield from groups(table.slice(0, cut))
        if kept is not None:
            yield from groups(kept)

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        node = table["node"].to_numpy()
        names = ("d", "t", "root_d", "root_t")
        d, t, root_d, root_t = (table[n].to_numpy() for n in names)
        sizes_of = [table[n].to_numpy().astype(np.int64) for n in ("n", "left")] if sized else []
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(d), -1)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.append(starts, len(node)))
        for size in np.unique(sizes[sizes > 1]).tolist():
            at = starts[sizes == size]
            step = max(1, 20_000 // (size * size))
            for first in range(0, len(at), step):
                rows = (at[first:first + step, None] + np.arange(size)).ravel()
                found = compare(d[rows], t[rows], root_d[rows], root_t[rows], sketch[rows], size,
                                *[column[rows] for column in sizes_of])
                if len(found[0]):
                    yield as_batch(schema, *found)

    columns = rows.select("node", "x.d", "x.t", F.col("root.d").alias("root_d"),
                          F.col("root.t").alias("root_t"), "sketch",
                          *(("n", "left") if sized else ()))
    found = columns.repartition("node").sortWithinPartitions("node", "d", "t").mapInArrow(
        emit, schema)
    return found.select(F.struct(F.col("d1").alias("d"), F.col("t1").alias("t")).alias("u"),
                        F.struct(F.col("d2").alias("d"), F.col("t2").alias("t")).alias("v"))


def alike_in_stars(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u leader, v) of ``stars`` that look alike."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8)
                          .reshape(len(batch), -1) for n in ("one", "other"))
            if len(batch):
                yield batch.select(["u", "v"]).filter(
                    pa.array((one == other).sum(1, dtype=np.uint8) >= ALIKE))

    sketches = sets.select("x", "sketch")
    leaders = sketches.select(F.col("x").alias("leader"), F.col("sketch").alias("one"))
    pair = stars.join(sketches.withColumnRenamed("sketch", "other"), "x").join(leaders, "leader")
    kind = "struct<d:bigint,t:bigint>"
    return pair.select(F.col("leader").alias("u"), F.col("x").alias("v"), "one", "other") \
        .mapInArrow(emit, f"u {kind}, v {kind}")


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many sets of ``texts`` hold a shingle, added up by buckets of shingles."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in few_rows(batch.column("text")):
                codes, _ = shingle_sets(data, offsets)
                np.add.at(total, bucket(codes), 1)
        some = np.flatnonzero(total)
        yield as_batch("bucket int, n long", some, total[some])

    # At most 2**BUCKET_BITS rows, however many texts there are.
    table = texts.select("text").mapInArrow(emit, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return counts


def bucket(codes: np.ndarray) -> np.ndarray:
    return (mix(codes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def size_classes() -> np.ndarray:
    """The smallest set size of each class; classes are 8 % wide."""
    limits = [0]
    while limits[-1] < 1 << 40:
        limits.append(max(limits[-1] + 1, limits[-1] * 108 // 100))
    return np.array(limits, np.int64)


def prefixes(texts: DataFrame) -> DataFrame:
    """(node, x, root, n, left) of ``texts`` (x, root, text): a node is a shingle and the
    size classes of the two sets that may meet there, ``left`` the shingles of the
    set from that one on.

    All sets have their shingles in one order, the rare ones first. Let w be the
    first shingle that two sets of n and m share. They share at most the smaller of
    what is left of both from w on, and need PERCENT / (100 + PERCENT) of n + m, so
    each has a row for w and the other's size class wherever they can be linked.
    """
    schema = "node long, d long, t long, root_d long, root_t long, n int, left int"
    shared = sent(texts.sparkSession, bucket_counts(texts))
    limits = size_classes()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = received(shared)
        for batch in batches:
            keys = [column_of(batch, name) for name in ("d", "t", "root_d", "root_t")]
            for low, high, data, offsets in few_rows(batch.column("text")):
                codes, at = shingle_sets(data, offsets)
                row = np.repeat(np.arange(high - low), np.diff(at))
                count = counts[bucket(codes)]
                order = np.lexsort((codes, count, row))
                codes, count, n = codes[order], count[order], np.diff(at)[row]
                left = n - (np.arange(len(row)) - at[:-1][row])
                least = -(-PERCENT * n // 100)
                most = np.minimum(100 * n // PERCENT,
                                  ((100 + PERCENT) * left - PERCENT * n) // PERCENT)
                # A bucket of one has a shingle that no other set holds.
                use = np.flatnonzero((most >= least) & (count > 1))
                own, first, last = (np.searchsorted(limits, size[use], "right") - 1
                                    for size in (n, least, most))
                many = last - first + 1
                each = np.repeat(np.arange(len(use)), many)
                other = first[each] + np.arange(len(each)) - np.repeat(
                    np.cumsum(many) - many, many)
                own, use = own[each], use[each]
                pair = np.minimum(own, other) << 12 | np.maximum(own, other)
                node = mix(mix(codes[use]) + pair.astype(np.uint64))
                yield as_batch(schema, node, *[key[low:high][row[use]] for key in keys],
                               n[use], left[use])

    rows = texts.select("x.d", "x.t", F.col("root.d").alias("root_d"),
                        F.col("root.t").alias("root_t"), "text").mapInArrow(emit, schema)
    return rows.select("node", F.struct("d", "t").alias("x"),
                       F.struct(F.col("root_d").alias("d"), F.col("root_t").alias("t"))
                       .alias("root"), "n", "left")


def rest(start: DataFrame, sets: DataFrame, texts: DataFrame, roots: DataFrame
         ) -> DataFrame | None:
    """Alike pairs (u, v) of different roots among documents that share a node of ``start``.

    Nothing is left out: every pair that can be linked shares a node of
    ``prefixes``. In a node only pairs of different roots matter. Large nodes that hold
    much the same documents are put together, and the union is compared once, in cells.
    """
    held = stored(start.join(roots, "x", "left")
                  .select("node", "x", F.coalesce("root", "x").alias("root")), "path-held")
    mixed = held.groupBy("node").agg(F.min("root").alias("a"), F.max("root").alias("b")).where(
        "a <> b").select("node")
    hot = stored(held.join(mixed, "node", "left_semi").select("x", "root").distinct(), "path-hot")
    if hot.isEmpty():
        return None
    hot_texts = stored(texts.join(hot, "x").dropDuplicates(["x"]), "path-hot-texts")
    rows = stored(prefixes(hot_texts), "path-prefixes")
    small, large = by_size(rows)
    # Shingles of one template are in much the same documents. Nodes are put together by
    # the smallest hash of their members, which two nodes share as often as the share of
    # members that they share: a pair meets there once, not at every shingle it has.
    unions = stored(large.groupBy("label", "x", "root").agg(
        F.max("n").alias("n"), F.max("left").alias("left")).withColumnRenamed("label", "node"),
        "path-unions")
    whole, cut = by_size(unions)
    dealt = small.unionByName(whole).unionByName(cells(cut.drop("label")))
    return alike_in_nodes(dealt.join(sets.select("x", "sketch"), "x"), all_pairs=True)


def by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of nodes with several roots: of up to BLOCK documents, and of more, those
    with ``label``, the smallest hash of the node's documents."""
    kinds = rows.groupBy("node", "root").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("x")).alias("label"))
    kinds = stored(kinds.groupBy("node").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.min("label").alias("label"))
        .where("kinds > 1").drop("kinds"), "path-kinds")
    small = rows.join(kinds.where(F.col("total") <= BLOCK).select("node"), "node", "left_semi")
    return small, rows.join(kinds.where(F.col("total") > BLOCK).select("node", "label"), "node")


def cells(rows: DataFrame) -> DataFrame:
    """``rows`` of nodes of more than BLOCK documents, dealt to cells of two blocks.

    Documents of the most frequent root of a node meet all others, and not each other.
    """
    kinds = rows.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
    kinds = stored(kinds.groupBy("node").agg(
        F.sum("n").alias("total"), F.max("n").alias("most"),
        F.max_by("root", F.struct("n", "root")).alias("lead")), "path-cells")
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    leads, others = parts(F.col("most")), parts(F.col("total") - F.col("most"))
    block = lambda of: F.pmod(F.xxhash64("x"), of).cast("int")
    cell = lambda kind, i, j: F.xxhash64("node", F.lit(kind), i, j)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    places = F.when(
        F.col("root") == F.col("lead"),
        F.transform(upto(others), lambda i: cell(1, i, block(leads)))).otherwise(F.concat(
            F.transform(upto(others), lambda j: cell(0, F.least(block(others), j),
                                                     F.greatest(block(others), j))),
            F.transform(upto(leads), lambda j: cell(1, block(others), j))))
    return rows.join(kinds, "node").select(F.explode(places).alias("node"), "x", "root", "n", "left")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets share enough, by the texts of ``docs`` (x, text)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                good = np.zeros(len(part), bool)
                sides = []
                for name in ("one", "other"):
                    sets = []
                    for _, _, data, offsets in few_rows(part.column(name)):
                        codes, at = shingle_sets(data, offsets)
                        sets += [codes[a:b] for a, b in zip(at[:-1], at[1:])]
                    sides.append(sets)
                for i, (a, b) in enumerate(zip(*sides)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good[i] = both and 100 * both >= PERCENT * (len(a) + len(b) - both)
                yield part.select(["u", "v"]).filter(pa.array(good))

    # Most documents are in no pair: their texts are not moved. The filter is as many
    # numbers as there are buckets at most, however many pairs there are.
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << PAIR_BITS)).cast("int")
    used = pairs.select(F.explode(F.array(bucket("u"), bucket("v"))).alias("bucket")).distinct()
    texts = docs.select("x", "text", bucket("x").alias("bucket")).join(
        F.broadcast(used), "bucket", "left_semi").drop("bucket")
    with_v = pairs.join(texts.select(F.col("x").alias("v"), F.col("text").alias("other")), "v")
    with_both = with_v.join(texts.select(F.col("x").alias("u"), F.col("text").alias("one")), "u")
    kind = "struct<d:bigint,t:bigint>"
    return with_both.select("u", "v", "one", "other").mapInArrow(emit, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and the
    text_key and component_text_key that tell rows of one doc_id apart.

    Documents are linked if their sets have a similarity of 0.75 or more;
    component_id is the smallest doc_id that links reach. Null and empty texts
    and texts without words have no shingles and are linked with nothing. Rows
    that repeat a doc_id are documents of their own with that id, so that two of
    them can both be ``kept``. A null doc_id is smaller than all others.
    """
    keyed = with_keys(docs).withColumn("x", F.struct("d", "t"))
    found = stored(signatures(keyed).withColumn("x", F.struct("d", "t")), "path-sets")
    classes = stored(
        found.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("x").alias("x")), "path-classes")
    sets = stored(found.join(classes.select("x"), "x", "left_semi")
                  .dropDuplicates(["x"]).select("x", "signature", "sketch"), "path-reps")
    texts = keyed.select("x", "text")
    small, stars, start = grow(sets)

    # Each document tries the smallest one it looks like in any node or star.
    alone = small.join(sets.select("x", "sketch"), "x").withColumn("root", F.col("x"))
    tries = alike_in_nodes(alone, all_pairs=False).unionByName(alike_in_stars(stars, sets))
    tries = stored(tries.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "path-tries")
    links = stored(confirmed(tries, texts), "path-links")
    roots = components(links)

    # What still looks alike across components.
    rooted = stored(small.join(roots, "x", "left")
                    .select("node", "x", F.coalesce("root", "x").alias("root")), "path-rooted")
    mixed = stored(rooted.groupBy("node").agg(F.min("root").alias("a"), F.max("root").alias("b"))
                   .where("a <> b").select("node"), "path-mixed")
    across = rooted.join(mixed, "node", "left_semi").join(sets.select("x", "sketch"), "x")
    starred = stars.join(roots.select("x", F.col("root").alias("r1")), "x", "left").join(
        roots.select(F.col("x").alias("leader"), F.col("root").alias("r2")), "leader", "left")
    starred = starred.where(F.coalesce("r1", "x") != F.coalesce("r2", "leader")).select(
        "x", "leader")
    more = alike_in_nodes(across, all_pairs=True).unionByName(alike_in_stars(starred, sets))
    more = stored(more.distinct().join(tries, ["u", "v"], "left_anti"), "path-more")
    if not more.isEmpty():
        links = links.unionByName(stored(confirmed(more, texts), "path-links2"))
        roots = components(links)

    # What large nodes may still hold.
    last = rest(start, sets, texts, roots)
    if last is not None:
        tried = tries.unionByName(more)
        last = stored(last.distinct().join(tried, ["u", "v"], "left_anti"), "path-last")
        if not last.isEmpty():
            links = links.unionByName(stored(confirmed(last, texts), "path-links3"))
            roots = components(links)

    of_class = classes.join(roots, "x", "left").select(
        "n", "s1", "s2", F.coalesce("root", "x").alias("root"))
    of_class = stored(of_class, "path-roots")
    joined = found.select("d", "t", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left")
    root = F.coalesce(F.col("root.d"), F.col("d"))
    public = lambda c: F.when(c != NO_ID, c)
    return joined.select(
        public(F.col("d")).alias("doc_id"), F.col("t").alias("text_key"),
        F.coalesce(F.col("root.t"), F.col("t")).alias("component_text_key"),
        F.col("n").alias("n_shingles"), public(root).alias("component_id"),
        (root == F.col("d")).alias("kept"))
