"""Tile grids for a picture size, as column expressions of the same size for any number
of candidates: their ratios are one sorted literal that is searched."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from quizlens.values import MAX_TILES, MIN_TILES, TILE_SIZE


def candidate_grids(min_tiles: int = MIN_TILES, max_tiles: int = MAX_TILES) -> list[tuple[int, int]]:
    """All (columns, rows) with an allowed number of tiles, smallest area first."""
    grids = [
        (cols, rows)
        for cols in range(1, max_tiles + 1)
        for rows in range(1, max_tiles // cols + 1)
        if cols * rows >= min_tiles
    ]
    return sorted(grids, key=lambda grid: (grid[0] * grid[1], grid[0]))


@dataclass(frozen=True)
class RatioIndex:
    """Candidate grids by aspect ratio: the distinct ratios in order, and for each the
    ranks of its grids in area order, one after the other from ``first``."""

    ratios: np.ndarray
    first: np.ndarray
    count: np.ndarray
    ranks: np.ndarray
    halves: np.ndarray

    @classmethod
    def of(cls, grids: Sequence[tuple[int, int]], tile_size: int) -> RatioIndex:
        ratios = np.array([c / r for c, r in grids])
        distinct, of_grid, count = np.unique(ratios, return_inverse=True, return_counts=True)
        ranks = np.argsort(of_grid, kind="stable")  # grids come in area order
        area = np.array([c * r for c, r in grids], float)
        return cls(distinct, np.cumsum(count) - count, count, ranks.astype(np.int32),
                   0.5 * tile_size * tile_size * area[ranks])


def ratios_up_to(ratio: Column, index: RatioIndex) -> Column:
    """How many ratios of the index are no larger, by binary search."""
    n = len(index.ratios)
    ratios = F.lit(index.ratios)

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        up = (at["low"] < at["high"]) & (F.get(ratios, middle) <= ratio)
        return F.struct(F.when(up, middle + 1).otherwise(at["low"]).alias("low"),
                        F.when(up, at["high"]).otherwise(F.least(middle, at["high"])).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(n.bit_length() + 1))
    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(steps, start, halve, lambda at: at["low"])


def closest_grid(area: Column, ratio: Column, upto: Column, index: RatioIndex) -> Column:
    """The rank of the chosen grid; ``upto`` comes from :func:`ratios_up_to`.

    Only the ratios on either side can be the closest. In area order the first grid at
    the smallest distance is taken, and each later one replaces it when the picture
    fills more than half of its area.
    """
    sides = [upto - 1, upto]
    distances = [F.abs(ratio - F.get(F.lit(index.ratios), side)) for side in sides]
    nearest = F.least(*distances)
    first, filled = [], []
    for side, distance in zip(sides, distances):
        tied = distance == nearest
        at = F.get(F.lit(index.first), side).cast("int")
        size = F.get(F.lit(index.count), side).cast("int")
        halves = F.slice(F.lit(index.halves), at + 1, size)
        full = F.size(F.filter(halves, lambda half: area > half))
        first.append(F.when(tied, F.get(F.lit(index.ranks), at)))
        filled.append(F.when(tied & (full > 0), F.get(F.lit(index.ranks), at + full - 1)))
    return F.greatest(F.least(*first), *filled)
