"""Budgets and draws, against SQL and a plain version."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from compare import compare, duck
from conftest import SF_CHECK, SF_TINY
from quizlens.llm import mixing, queries, topk


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", [SF_TINY, SF_CHECK])
def test_query_agrees_with_sql(spark, name, sf):
    assert compare(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name]) == ""


def fill(budget, nodes):
    """Share a budget by weight, again and again among those with room. nodes: [(cap, weight)]."""
    got = [0.0] * len(nodes)
    open_nodes = set(range(len(nodes)))
    while open_nodes and budget > 1e-9:
        total = sum(nodes[i][1] for i in open_nodes)
        full = {i for i in open_nodes if got[i] + budget * nodes[i][1] / total >= nodes[i][0] - 1e-9}
        if not full:
            for i in open_nodes:
                got[i] += budget * nodes[i][1] / total
            return got
        for i in full:
            budget -= nodes[i][0] - got[i]
            got[i] = float(nodes[i][0])
        open_nodes -= full
        level = max((got[i] / nodes[i][1] for i in open_nodes), default=0)
        for i in open_nodes:  # those with room start over from nothing
            budget += got[i]
            got[i] = 0.0
        assert level >= 0
    return got


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"d{rng.randrange(3)}", rng.choice(["en", "de", None]), f"s{i}"): rng.randrange(0, 200)
              for i in range(25)}
    rows = [(*k, t, 2 * t) for k, t in leaves.items()]
    frame = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, capacity long")
    total = sum(leaves.values())
    budget = int(total * rng.choice([0.3, 0.9, 1.5, 5]))
    weight = lambda level: (F.when(F.col("domain") == "d0", 3.0).otherwise(1.0) if level == "domain"
                            else F.when(F.col("lang") == "en", 2.0).otherwise(1.0) if level == "lang"
                            else F.lit(1.0))
    got = {(r.domain, r.lang if r.lang != "\x00" else None, r.source): r.granted
           for r in mixing.budgets(frame, F.lit(budget), weight).collect()}

    def share(budget, keys, depth):
        groups = defaultdict(list)
        for k in keys:
            groups[k[depth]].append(k)
        names = list(groups)
        weights = {0: lambda n: 3.0 if n == "d0" else 1.0, 1: lambda n: 2.0 if n == "en" else 1.0,
                   2: lambda n: 1.0}[depth]
        parts = fill(budget, [(2 * sum(leaves[k] for k in groups[n]), weights(n)) for n in names])
        for n, part in zip(names, parts):
            if depth == 2:
                want[groups[n][0]] = part
            else:
                share(part, groups[n], depth + 1)

    want = {}
    share(budget, list(leaves), 0)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) <= 1.001 for k in want)
    assert abs(sum(want.values()) - min(budget, 2 * total)) < 1e-6


def test_draw_repeats_rows_by_their_copies(spark):
    text = lambda i: " ".join(["w"] * (i % 7 + 1))
    rows = [(i, text(i), "en" if i % 3 else None, f"src{i % 4}", "x") for i in range(60)]
    rows += [(1, text(1), "en", "src1", "x")] * 2 + [(None, None, None, None, None), (2, "other", "en", "src2", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, draw string")
    for budget in (50, 400, 10**6):
        mixed = mixing.mix(frame, budget=budget)
        drawn = mixing.draw(frame, budget=budget)
        assert drawn.columns == frame.columns
        want = Counter()
        for r in mixed.collect():
            want[r.doc_id, r.lang, r.source, r.n_words] += r.copies
        assert Counter((r.doc_id, r.lang, r.source, len((r.text or "").split()))
                       for r in drawn.collect()) == want
        assert sum(r.n_words * r.copies for r in mixed.collect()) <= budget
    assert all(n == 2 for n in Counter(r.doc_id for r in drawn.collect() if r.doc_id and r.doc_id > 2).values())
    assert mixing.mix(frame.limit(0)).collect() == [] and mixing.draw(frame.limit(0)).collect() == []


def test_another_epoch_has_another_order(spark):
    rows = [(i, "one two three", "en", "src1") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    half = {r.doc_id for r in mixing.mix(frame, budget=300).collect()}
    more = {r.doc_id for r in mixing.mix(frame, budget=900).collect() if r.copies == 2}
    assert len(half) == len(more) == 100 and half != more
    assert half != {r.doc_id for r in mixing.mix(frame, budget=300, seed="other").collect()}


def plain_top(rows, is_query, k=5):
    out = []
    for q, v in rows.items():
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows.items()
                            if i != q and len(w) == len(v))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("slices,block", [(1, 50), (3, 7), (4, 1000)])
def test_top_k_of_odd_vectors(spark, slices, block):
    import math
    rng = random.Random(slices)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(30)] + [(300, [1.0, 2.0]), (310, [3.0, 1.0]), (320, [9.0])]
    rows += [(301, [60000.0] * 6), (302, [-70000.0] * 6), (303, [70000.0] * 6)]
    odd = [(400, None), (401, []), (402, [1.0, None] + [0.0] * 4), (403, [float("nan")] * 6),
           (404, [float("inf")] * 6), (None, [1.0] * 6), (0, rows[0][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    want = plain_top({i: [math.floor(256 * x) for x in v] for i, v in rows}, lambda i: i % 10 == 0)
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0, slices=slices, block=block, query_block=3)
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).collect() == []
