"""Removal of repeated bytes and words against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

import __spark_entry__  # noqa: F401  (workers get the package with the task)
from quizlens.llm import seed_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, d string, t string, first string"


def removed_units(docs, length, keep_first):
    """docs: list of sequences in order; booleans per unit."""
    places = defaultdict(list)
    for i, units in enumerate(docs):
        for s in range(len(units) - length + 1):
            places[tuple(units[s:s + length])].append((i, s))
    out = [[False] * len(u) for u in docs]
    for found in places.values():
        if len(found) > 1:
            for i, s in found[1:] if keep_first else found:
                out[i][s:s + length] = [True] * length
    return out


def corpus(seed, unit):
    rng = random.Random(seed)
    sep = "" if unit == "bytes" else " "
    alphabet = ["a", "b", "é", "x"] if unit == "bytes" else ["ab", "c", "Dé", "e.", "f", "gg"]
    text = lambda n: sep.join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randint(5, 60)) for _ in range(6)]
    docs = [None, "", " \t\n ", "a"]
    for _ in range(50):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(0, 40))
                 for _ in range(rng.randint(1, 5))]
        docs.append(sep.join(parts))
    docs += [docs[7], docs[8] + sep + text(3), docs[8], "a" * 70, "a" * 41,
             sep.join(["ab", "c"] * 40)]
    return docs


def spans(flags):
    return sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, keep_first):
    docs = corpus(seed, "bytes")
    frame = spark.createDataFrame([(i, t, "x", None, "y") for i, t in enumerate(docs)], SCHEMA)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(
        frame, 20, keep_first, gram=4, block=5).collect()}
    raw = [(t or "").encode() for t in docs]
    for i, flags in enumerate(removed_units(raw, 20, keep_first)):
        kept = bytes(b for b, f in zip(raw[i], flags) if not f)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (
            len(raw[i]), sum(flags), spans(flags), kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert len(got) == len(docs)


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, seed, keep_first):
    docs = corpus(seed, "words")
    frame = spark.createDataFrame([(i, t, "x", None, "y") for i, t in enumerate(docs)], SCHEMA)
    got = {r.doc_id: r for r in seed_dedup.remove_repeats(
        frame, 12, keep_first, gram=3).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in docs]
    for i, flags in enumerate(removed_units(words, 12, keep_first)):
        kept = " ".join(w for w, f in zip(words[i], flags) if not f)
        assert (got[i].n_words, got[i].n_removed, got[i].n_repeats, got[i].kept) == (
            len(words[i]), sum(flags), spans(flags), kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("remove", [suffix_dedup.remove_repeats, seed_dedup.remove_repeats])
def test_repeated_rows_null_ids_and_no_rows(spark, remove):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (1, long), (None, long), (None, None), (1, "other text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove(frame, keep_first=False).collect()
    assert len(got) == 5
    assert sorted((r[1], r[2]) for r in got if r[1] > 12) == [(got_n, got_n) for got_n in
                                                              [max(r[1] for r in got)] * 3]
    assert remove(frame.limit(0)).collect() == []


@pytest.mark.parametrize("remove", [suffix_dedup.remove_repeats, seed_dedup.remove_repeats])
def test_one_of_repeated_rows_is_the_first(spark, remove):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(2, long)] * 4 + [(3, long), (1, "w0 w1"), (1, "w0 w1"), (5, None), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r[0], r[1], r[2]) for r in remove(frame, keep_first=True).collect())
    n, short = max(r[1] for r in got), min(r[1] for r in got if r[0] == 1)
    assert got == [(1, short, 0)] * 2 + [(2, n, 0)] + [(2, n, n)] * 3 + [(3, n, n)] + [(5, 0, 0)] * 2
