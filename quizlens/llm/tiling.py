"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document are compared by tiles: stretches of equal words
in both, none overlapping another, the longest first. Order does not matter, so
a passage whose sentences were rearranged is still covered. An item counts as
contained in a document if tiles cover at least ``COVERAGE`` of its words.

Seeds are word grams of the shortest tile's length, found by a running
(Karp-Rabin) hash over each document; equal seeds on one diagonal grow into
matches. A tile consists of seeds, so a document whose seeds cannot cover enough
of an item is left out without losing any.

Words are runs of letters, digits and non-ASCII characters, with A-Z in lower
case. Items with fewer words than a tile count as one tile each: all their words
must stand together. Null and empty texts, and items without words, match
nothing. Rows that repeat a document or an item are compared each time.

The benchmark travels to the tasks in blocks of up to ``BLOCK_BYTES`` of text:
one pass over the documents for each block, so that a benchmark of any size
works and none is broadcast whole. Documents are never shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quizlens.llm.codes import GRAMS, PUNCTUATION, CodeSet, Sums, Words, pieces
from quizlens.llm.sending import received, sent
from quizlens.llm.windows import NO_ID, as_batch, column_of, free_names, with_keys
from quizlens.session import stored

TILE = 5
COVERAGE = 0.6
BLOCK_BYTES = 8 << 20

SCHEMA = ("d long, t long, item_id long, item_words long, covered_words long, n_tiles int, "
          "longest_tile int, coverage double")


def token_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offsets, lower=True, separators=PUNCTUATION)
    return words.codes(), words.bounds


def tiles(i: np.ndarray, j: np.ndarray, gram: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, length) from all equal grams (i, j).

    The longest match goes first, of equal ones the one that is earliest in the
    item and then in the document. A match that runs into a tile is cut there
    and waits its turn again.
    """
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(i))) + gram - 1
    heap = [(-n, a, b) for n, a, b in zip(length.tolist(), i[at].tolist(), j[at].tolist())]
    heapq.heapify(heap)
    used_i, used_j, found = set(), set(), []
    while heap:
        size, a, b = heapq.heappop(heap)
        free = [a + k not in used_i and b + k not in used_j for k in range(-size)]
        if all(free):
            found.append((a, b, -size))
            used_i.update(range(a, a - size))
            used_j.update(range(b, b - size))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= gram:
                    heapq.heappush(heap, (start - k, a + start, b + start))
                start = None
    return found


class Items:
    """Seeds of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], gram: int):
        self.ids = np.array(ids, np.int64)
        self.size = np.zeros(len(ids), np.int64)
        codes, item, place = [], [], []
        for low, high, data, offsets in pieces(pa.array(texts, pa.string())):
            words, bounds = token_codes(data, offsets)
            n = np.diff(bounds)
            self.size[low:high] = n
            sums = Sums(words, GRAMS)
            for k in range(low, high):
                m, begin = int(n[k - low]), int(bounds[k - low])
                size = min(gram, m)
                at = begin + np.arange(m - size + 1 if m else 0)
                codes.append(sums.of(at, at + size))
                item.append(np.full(len(at), k))
                place.append(at - begin)
        codes, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64)
                              for x in (codes, item, place))
        # Hashes hold the length of what is hashed: seeds of all lengths share one set.
        self.lengths = sorted({min(gram, int(n)) for n in self.size if n})
        self.set = CodeSet(codes)
        order = np.argsort(codes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.start = np.searchsorted(codes[order], self.set.codes)
        self.count = np.diff(np.append(self.start, len(codes)))


def find_items(docs: DataFrame, items: Items, gram: int, coverage: float) -> DataFrame:
    """Rows of ``SCHEMA`` for ``with_keys`` documents."""
    shared = sent(docs.sparkSession, items)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = received(shared)
        for batch in batches:
            d, t = column_of(batch, "d"), column_of(batch, "t")
            rows = []
            for low, high, data, offsets in pieces(batch.column("text")):
                words, bounds = token_codes(data, offsets)
                sums, row = Sums(words, GRAMS), np.repeat(np.arange(high - low), np.diff(bounds))
                for size in items.lengths:
                    at = np.arange(max(0, len(words) - size + 1))
                    at = at[row[at] == row[at + size - 1]]
                    place, code = items.set.find(sums.of(at, at + size))
                    if len(place):
                        rows += compare(items, size, at[place], row[at[place]], code, bounds, low)
            if rows:
                k = np.array([r[0] for r in rows])
                yield as_batch(SCHEMA, d[k], t[k], *map(np.array, list(zip(*rows))[1:]))

    def compare(items, size, at, row, code, bounds, low):
        count = items.count[code]
        each = np.repeat(np.arange(len(at)), count)
        entry = items.start[code][each] + np.arange(len(each)) - np.repeat(
            np.cumsum(count) - count, count)
        item, i = items.item[entry], items.place[entry]
        row, j = row[each], (at - bounds[row])[each]
        fits = np.minimum(items.size[item], gram) == size
        item, i, row, j = (x[fits] for x in (item, i, row, j))
        order = np.lexsort((item, row))
        item, i, row, j = (x[order] for x in (item, i, row, j))
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(item))
        # A tile of n words has n - gram + 1 seeds, at least a gram-th of n.
        wanted = np.ceil(coverage * items.size[item[begin]] - 1e-9)
        out = []
        for a, b, need in zip(begin.tolist(), end.tolist(), wanted.tolist()):
            places = np.unique(i[a:b])
            if len(places) * size < need:
                continue
            could = np.unique(places[:, None] + np.arange(size))
            if len(could) < need:
                continue
            found = tiles(i[a:b], j[a:b], size)
            covered = sum(n for *_, n in found)
            if covered >= need:
                k = int(item[a])
                out.append((low + int(row[a]), int(items.ids[k]), int(items.size[k]), covered,
                            len(found), max(n for *_, n in found), covered / int(items.size[k])))
        return out

    return docs.select("d", "t", "text").mapInArrow(emit, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = TILE,
                 coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document of ``with_keys`` and item that it contains."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes) or 1
    found = None
    for block in range(blocks):
        # Bounded by block_bytes on average, and by the longest item.
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        table = part.orderBy("item_id", "text").toArrow()
        seeds = Items([i if i is not None else -1 for i in table["item_id"].to_pylist()],
                      table["text"].to_pylist(), gram)
        rows = find_items(docs, seeds, gram, coverage)
        rows = stored(rows, f"tiles-{block}") if blocks > 1 else rows
        found = rows if found is None else found.unionByName(rows)
    return found


def report(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, item_id and the tiling of every contaminated pair."""
    rows = contaminated(with_keys(docs), benchmark, **settings)
    return rows.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"),
                       *[part.split()[0] for part in SCHEMA.split(", ")][2:])


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns."""
    keyed = with_keys(docs)
    bad = stored(contaminated(keyed, benchmark, **settings).select("d", "t").distinct(),
                 "tiles-bad")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d, t = free_names(docs, "_d", "_t")
    marked = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                               t: F.xxhash64(text)})
    bad = bad.select(F.col("d").alias(d), F.col("t").alias(t))
    return marked.join(bad, [d, t], "left_anti").select(*docs.columns)
