"""Grids among many candidates, and listings by tasks."""

import os
import random

import pytest

from quizlens.functions.tiling import candidate_grids
from quizlens.operators import tiles
from quizlens.sources.listing import list_files, list_tree


def plain_choice(width, height, grids, size):
    """In area order, the first at the smallest distance; later ones by the area rule."""
    distances = [abs(width / height - c / r) for c, r in grids]
    best = None
    for i, (c, r) in enumerate(grids):
        if distances[i] == min(distances) and (
                best is None or width * height > 0.5 * size * size * c * r):
            best = i
    return best


@pytest.mark.parametrize("few,many", [(1, 12), (1, 200), (5, 40), (1, 1)])
def test_choice_among_many_grids(spark, few, many):
    draw, grids = random.Random(many), candidate_grids(few, many)
    sizes = [(draw.randint(1, 6000), draw.randint(1, 6000)) for _ in range(1500)]
    sizes += [(c * k, r * k) for c, r in grids[:120] for k in (1, 300, 448, 3000)]
    # Between two ratios, at the same distance from both.
    sizes += [(3, 4), (3000, 4000), (5, 4), (7, 8), (1, 100_000), (100_000, 1), (2**31 - 1, 1)]
    rows = [(i, w, h) for i, (w, h) in enumerate(sizes)]
    images = spark.createDataFrame([*rows, (-1, None, 5), (-2, 5, None)], "image_id long, width int, height int")
    got = {r.image_id: r for r in tiles.plan_grids(images, few, many).collect()}
    assert got[-1].grid_rank is None and got[-2].cols is None
    for i, w, h in rows:
        want = plain_choice(w, h, grids, 448)
        assert (got[i].grid_rank, got[i].cols, got[i].rows) == (want, *grids[want]), (w, h)


def test_plans_do_not_grow_with_the_candidates(spark):
    images = spark.createDataFrame([(1, 2, 3)], "image_id long, width int, height int")

    def nodes(many):
        plan = tiles.plan_grids(images, 1, many)._jdf.queryExecution().analyzed().treeString()
        return plan.count("get("), plan.count("lambda")

    assert nodes(12) == nodes(300)


def test_trees_are_listed_by_tasks(spark, tmp_path):
    for path in ("a/1.txt", "a/b/c/2.txt", "a/b/3.jpg", "x y/é[1].txt", "_k=1/4.txt", "_hidden/5.txt",
                 "a/.6.txt", "a/_7.txt", "8.txt"):
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(path)
    os.makedirs(tmp_path / "none/at/all")
    key = lambda frame: sorted(map(tuple, frame.collect()))
    want = key(list_files(spark, str(tmp_path), recursive=True))
    got = list_tree(spark, str(tmp_path))
    assert key(got.select("path", "length")) == want and len(want) == 6
    assert len(key(list_tree(spark, str(tmp_path), "*.jpg"))) == 1
    assert {r.path for r in list_tree(spark, str(tmp_path / "x y"), prefix="./d/").collect()} == {"./d/é[1].txt"}
    assert list_tree(spark, str(tmp_path / "none")).collect() == []
