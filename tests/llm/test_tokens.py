"""Token ids, their histogram and their files."""

import glob
import os

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings, strategies as st

import __spark_entry__  # noqa: F401  (workers get the package with the task)
import brute
from conftest import SF_TINY
from quizlens.llm import length_histogram, token_files
from quizlens.llm.codes import pieces
from quizlens.llm.encoding import WordEncoder

ENCODER = WordEncoder()
ODD = ["", " ", "A b c", "é ́x", "<|startoftext|>a <|endoftext|>", "don't  we'll\n\tGO",
       "\x1c\x1f \x85", "日本語 テキスト", "🙂🙂 x", "ΣΑΣ σας", "a" * 3000, "x\x00y", "#!? ...", "İI ı", "a1b22c,d..e", "<b>x</b>", "I'LL we'Re", "\x7f\x01a", "\u00a0A\u2003b", "A\u0301 e\u0301"]


def encoded(texts):
    out = []
    for _, _, data, offsets in pieces(pa.array(texts, pa.string()), 50):
        ids, bounds = ENCODER.encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_odd_texts_have_the_librarys_ids():
    assert encoded(ODD) == brute.token_ids(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_texts_have_the_librarys_ids(texts):
    texts = [t.encode("utf8", "ignore").decode() for t in texts]
    assert encoded(texts) == brute.token_ids(texts)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("quizlens.llm.encoding.KEPT_UNITS", 3)
    texts = ["a b c d e f", "f e d c b a g h"] * 3
    assert encoded(texts) == brute.token_ids(texts)


def test_files_hold_all_documents(spark, tmp_path):
    docs = brute.documents(SF_TINY)
    frame = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    manifest = token_files.write_tokens(frame, str(tmp_path / "t"))
    want = brute.token_rows(docs)
    got = token_files.read_tokens(manifest, digest=True).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(docs)
    few = token_files.read_tokens(manifest, wanted=[7, 3]).collect()
    texts = dict(docs)
    assert {r.doc_id: (r.start, list(r.ids)) for r in few} == {
        d: (want[d][0], brute.token_ids([texts[d]])[0] + [1]) for d in (3, 7)}
    files = glob.glob(f"{tmp_path}/t/part-*.zst")
    assert files and not glob.glob(f"{tmp_path}/t/.part*")
    # Any Zstandard tool reads the frames one after the other and skips the table.
    with open(files[0], "rb") as f:
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    reader = token_files.FrameReader(files[0])
    assert whole == b"".join(reader.frame(i) for i in range(len(reader.size)))


def test_frames_are_independent_and_checked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 10)
    docs = [(i, "word " * (i % 23)) for i in range(60)]
    manifest = token_files.write_tokens(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), str(tmp_path / "t"))
    got = token_files.read_tokens(manifest, digest=True).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == brute.token_rows(docs)
    rows = [r for r in manifest.collect() if r.n_docs]
    assert len(rows) > 10 and all(r.n_ids <= 10 or r.n_docs == 1 for r in rows)
    path = next(r.path for r in rows if r.frame > 1).removeprefix("file:")
    reader = token_files.FrameReader(path)
    raw = bytearray(open(path, "rb").read())
    raw[reader.start[1] + 9] ^= 0xFF
    with open(path + ".bad", "wb") as f:
        f.write(raw)
    bad = token_files.FrameReader(path + ".bad")
    assert bad.frame(0) == reader.frame(0)
    with pytest.raises(Exception):
        bad.frame(1)


def test_nulls_repeated_rows_and_no_rows(spark, tmp_path):
    rows = [(2, None, "x"), (2, "b a", "y"), (2, "b a", "y"), (None, "c", "z"), (1, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = token_files.write_tokens(frame, str(tmp_path / "a"))
    got = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 2] and all(r.ids[-1] == 1 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 3]
    none = token_files.write_tokens(frame.limit(0), str(tmp_path / "b"))
    assert token_files.read_tokens(none).collect() == [] and os.listdir(tmp_path / "b") == ["manifest"]


def test_histogram_answers_every_limit(spark):
    docs = [(i, t) for i, t in enumerate([None, "", *ODD, *["a b c"] * 7, "word " * 5000])]
    lengths = np.array([len(x) for x in brute.token_ids([t for _, t in docs])])
    hist = length_histogram.histogram(spark.createDataFrame(docs, "doc_id long, text string"))
    table = length_histogram.limits(hist)
    for r in table.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_within, r.tokens_within, r.docs_over, r.truncated_tokens, r.lost_tokens) == (
            (lengths == n).sum(), (lengths <= n).sum(), lengths[lengths <= n].sum(), (lengths > n).sum(),
            np.minimum(lengths, n).sum(), (lengths - np.minimum(lengths, n)).sum())
    asked = [0, 1, 2, 100, 4096, 10**6]
    for r in length_histogram.at_limits(table, asked).collect():
        assert (r.docs_within, r.docs_over, r.truncated_tokens) == (
            (lengths <= r.limit).sum(), (lengths > r.limit).sum(), np.minimum(lengths, r.limit).sum())
    for r in length_histogram.quantiles(table).collect():
        assert r.n_tokens == min(n for n in lengths if (lengths <= n).mean() >= r["quantile"])
    empty = length_histogram.limits(hist.limit(0))
    assert empty.collect() == [] and length_histogram.at_limits(empty, asked).collect() == []


def test_reading_has_as_many_tasks_as_the_ids_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "TASK_IDS", 20_000)
    frame = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    monkeypatch.setattr(token_files, "FRAME_IDS", 500)
    manifest = token_files.write_tokens(frame, str(tmp_path / "t"))
    ids = sum(r.n_ids for r in manifest.collect())
    digests = token_files.read_tokens(manifest, digest=True)
    assert digests.rdd.getNumPartitions() == -(-ids // 20_000) > 4
    assert digests.count() == frame.count()
    assert {r.path.split("/")[0] for r in manifest.select("path").distinct().collect()} == {"file:"}
