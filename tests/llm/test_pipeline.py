"""The pipeline's stages, each against what it is said to keep."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from conftest import SF_TINY
from quizlens.llm import tiling, toxicity


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, found = spark.read.parquet(f"{SF_TINY}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_TINY).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        found.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in found}


def ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_order_and_columns(steps):
    assert list(steps) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    for name, (before, after) in steps.items():
        if name != "token_files":
            assert after.dtypes == before.dtypes and 0 < after.count()


def test_toxicity_keeps_what_is_not_rejected(spark, steps):
    before, after = steps["toxicity"]
    labels = spark.read.parquet(f"{SF_TINY}/labels.parquet")
    scores = toxicity.score(before, labels)
    assert ids(after) == ids(scores.where("predicted = 0"))


def test_one_of_each_group_stays(steps):
    before, after = steps["near_duplicates"]
    groups = brute.near_duplicates([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == Counter({root: 1 for _, root in groups.values()})


def test_documents_with_items_go(spark, steps):
    before, after = steps["decontamination"]
    bad = tiling.report(before, spark.read.parquet(f"{SF_TINY}/benchmark.parquet"))
    assert ids(after) == ids(before) - Counter(r.doc_id for r in bad.collect())


def test_mixed_rows_are_whole_documents(steps):
    before, after = steps["mixing"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(texts[r.doc_id] == r.text for r in after.collect())
    assert max(ids(after).values()) <= 2


def test_files_hold_every_row(steps):
    before, after = steps["token_files"]
    docs = sorted((r.doc_id, r.text) for r in before.collect())
    lengths = [len(x) + 1 for x in brute.token_ids([t for _, t in docs])]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in after.collect())
    starts = [sum(lengths[:i]) for i in range(len(docs))]
    assert got == [(s, d, n) for s, (d, _), n in zip(starts, docs, lengths)]


def test_odd_rows_pass_all_stages(spark, tmp_path):
    labels = spark.read.parquet(f"{SF_TINY}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF_TINY}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, None, None, None, None), (None, "", "en", "src1", 0), (2, "a b c", "en", "src1", 5),
            (2, "a b c", "en", "src1", 5), (2, "d e f", "de", "src2", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        some.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert {r.doc_id for r in out.collect()} <= {None, 1, 2}


CLASHING = ("_t", "_d", "_l", "_s", "_n", "_copy", "copies", "_score", "_text", "d", "t", "x",
            "node", "root", "score", "words", "rows", "granted", "_C0")


@pytest.mark.parametrize("at", range(4))
def test_columns_of_the_user_stay_as_they_are(spark, at):
    """Columns with the names of working columns, nulls, empty texts and repeated rows."""
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").limit(60)
    odd = docs.limit(1).selectExpr(*[f"cast(null as {k}) as {n}" for n, k in docs.dtypes])
    docs = docs.unionByName(docs.limit(3)).unionByName(odd).unionByName(
        odd.withColumn("text", F.lit("")))
    marked = docs.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, 0)) as {c}" for c in CLASHING])
    name, stage = corpus_pipeline.STAGES[at]
    plain = sorted(map(str, stage(spark, docs, SF_TINY).collect()))
    after = stage(spark, marked, SF_TINY)
    assert after.columns == marked.columns
    assert all(r[c] == f"{c}{r.doc_id or 0}" for r in after.collect() for c in CLASHING)
    assert sorted(map(str, after.select(*docs.columns).collect())) == plain
    assert stage(spark, marked.where("false"), SF_TINY).collect() == []
