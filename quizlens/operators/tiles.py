"""Tile plans: the grid for each picture size, and the box of each tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quizlens.functions.tiling import RatioIndex, candidate_grids, closest_grid, ratios_up_to
from quizlens.operators.literals import literal_table
from quizlens.values import MAX_TILES, MIN_TILES, TILE_SIZE


def grid_table(spark: SparkSession, min_tiles: int = MIN_TILES,
               max_tiles: int = MAX_TILES) -> DataFrame:
    """The candidate grids with their rank in area order."""
    rows = [(c, r, c * r, i) for i, (c, r) in enumerate(candidate_grids(min_tiles, max_tiles))]
    return literal_table(spark, "cols int, rows int, area int, grid_rank int", rows)


def plan_grids(images: DataFrame, min_tiles: int = MIN_TILES, max_tiles: int = MAX_TILES,
               tile_size: int = TILE_SIZE) -> DataFrame:
    """Add the chosen grid, its target size and its number of tiles.

    The candidates are a few array literals, so the rows are neither joined nor
    multiplied, and the plan has no shuffle; some thousand candidates make it no larger.
    """
    grids = candidate_grids(min_tiles, max_tiles)
    index = RatioIndex.of(grids, tile_size)
    width, height = F.col("width"), F.col("height")
    area = width.cast("bigint") * height.cast("bigint")
    chosen = (
        images.withColumn("_ratio", width.cast("double") / height.cast("double"))
        .withColumn("_upto", ratios_up_to(F.col("_ratio"), index))
        .withColumn("grid_rank", closest_grid(area, F.col("_ratio"), F.col("_upto"), index))
    )
    cols, rows = (F.lit(np.array(side, np.int32)) for side in zip(*grids))
    return (
        chosen.drop("_ratio", "_upto")
        .withColumns({"cols": F.get(cols, "grid_rank"), "rows": F.get(rows, "grid_rank")})
        .withColumns({
            "blocks": F.col("cols") * F.col("rows"),
            "target_w": F.col("cols") * F.lit(tile_size),
            "target_h": F.col("rows") * F.lit(tile_size),
        })
    )


def grid_usage(images: DataFrame, min_tiles: int = MIN_TILES, max_tiles: int = MAX_TILES,
               tile_size: int = TILE_SIZE) -> DataFrame:
    """Every candidate grid with the number of pictures that take it, zero included."""
    keys = ["cols", "rows", "area", "grid_rank"]
    taken = plan_grids(images, min_tiles, max_tiles, tile_size).select(
        "cols", "rows", F.col("blocks").alias("area"), "grid_rank", F.lit(1).alias("images"))
    every = grid_table(images.sparkSession, min_tiles, max_tiles).withColumn("images", F.lit(0))
    return taken.unionByName(every).groupBy(*keys).agg(
        F.sum("images").cast("bigint").alias("images"))


def tile_boxes(grids: DataFrame, tile_size: int = TILE_SIZE, thumbnail: bool = True) -> DataFrame:
    """One row per tile of each picture, row by row from the top left.

    A picture of more than one tile also gets the whole picture as a last,
    flagged tile. Its box is the full tile square the picture is scaled to.
    """
    last = F.col("blocks") - 1
    if thumbnail:
        last = F.when(F.col("blocks") != 1, F.col("blocks")).otherwise(last)
    tile = F.col("tile")
    whole = tile == F.col("blocks")
    left = F.when(whole, 0).otherwise((tile % F.col("cols")) * tile_size)
    top = F.when(whole, 0).otherwise(F.floor(tile / F.col("cols")).cast("int") * tile_size)
    return (
        grids.withColumn("tile", F.explode(F.sequence(F.lit(0), last)))
        .withColumns({"is_thumbnail": whole, "x0": left, "y0": top})
        .withColumns({"x1": F.col("x0") + tile_size, "y1": F.col("y0") + tile_size})
    )
