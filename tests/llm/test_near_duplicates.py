"""Near-duplicate groups and components against plain versions."""

import random

import pytest

import __spark_entry__  # noqa: F401  (workers get the package with the task)
import brute
from quizlens.llm import chosen_path
from quizlens.llm.components import components
from conftest import SF_TINY


def got_groups(frame):
    rows = chosen_path.near_duplicates(frame).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}, rows


def test_given_documents(spark):
    frame = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    got, rows = got_groups(frame)
    assert got == brute.near_duplicates(brute.documents(SF_TINY))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("node", [3, 32])
def test_large_groups_chains_and_short_texts(spark, monkeypatch, node):
    """With small nodes, groups of near copies go through stars and several levels."""
    monkeypatch.setattr(chosen_path, "NODE", node)
    rng = random.Random(node)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [None, "", " \n ", "One two", "one TWO", "one two three", "x", "x"]
    base = [word() for _ in range(120)]
    for _ in range(60):  # near copies of one text
        copy = list(base)
        copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for step in range(12):  # each is near the one before, the ends are not
        texts.append(" ".join(chain[:100]))
        chain = chain[2:] + [word(), word()]
    texts += [" ".join(word() for _ in range(50)) for _ in range(20)] + [" ".join(base)] * 5
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got, _ = got_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute.near_duplicates(docs)


@pytest.mark.parametrize("node,block", [(32, 256), (4, 16)])
def test_near_pairs_in_a_template_group(spark, monkeypatch, node, block):
    """All members share a template and are below the threshold, but for pairs."""
    monkeypatch.setattr(chosen_path, "NODE", node)
    monkeypatch.setattr(chosen_path, "BLOCK", block, raising=False)
    rng = random.Random(node)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, docs = words(292), []
    for pair in range(300):
        both = words(14)
        for _ in range(2):
            docs.append((len(docs), " ".join(template + both + words(rng.randrange(44, 47)))))
    docs += [(len(docs) + i, " ".join(template + words(60))) for i in range(100)]
    rng.shuffle(docs)
    want = brute.near_duplicates(docs)
    assert len({c for _, c in want.values()}) == 400
    got, _ = got_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == want


def test_repeated_and_null_ids_and_no_rows(spark):
    text = "a b c d e f g h"
    rows = [(5, text, "x"), (5, text, "y"), (5, "other words", "x"), (None, None, None), (9, text, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = chosen_path.near_duplicates(frame)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found.collect()) == [
        (0, 0, 0), (5, 1, 5), (5, 4, 5), (5, 4, 5), (9, 4, 5)]
    assert chosen_path.near_duplicates(frame.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    rng.shuffle(edges)
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.x: r.root for r in found} == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
