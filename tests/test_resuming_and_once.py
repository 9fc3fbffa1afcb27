"""Asking that goes on after a stop, answers appended once, and tensor models."""

import glob
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from quizlens.operators import answering, requests, resuming, tensors
from quizlens.sources import answers as answer_files, once
from quizlens.values import POLICIES


@pytest.fixture(scope="module")
def asked(spark):
    """Both questions about 12 pictures to three models."""
    listing = spark.range(12).select(
        (F.col("id") % 2 + 1).cast("int").alias("id"), F.concat(
            F.lit("./dataset/i"), F.col("id") % 2 + 1, F.lit("_flore_"), "id", F.lit(".jpg")).alias("path"))
    models = spark.createDataFrame([(p.model,) for p in POLICIES[:3]], "model string")
    pictures = listing.withColumns({"city": F.lit("Roma"), "subject": F.lit("Arena")}).join(models)
    return requests.add_policy(requests.pair_requests(pictures, ["eng", "ita"]))


def logging_responder(folder, fails_after=None):
    """The plain responder; it notes what it was asked, and fails once that is too much."""
    def make():
        respond = answering.make_plain_responder()

        def noted(batch):
            if fails_after is not None and len(os.listdir(folder)) >= fails_after:
                raise RuntimeError("stopped")
            for path, model, dialogue in zip(batch["path"], batch["model"], batch["dialogue"]):
                turns = [p["text"] for t in dialogue for p in t["content"] if p["type"] == "text"]
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as note:
                    json.dump([path, model, " / ".join(turns)], note)
            return respond(batch)
        return noted
    return make


def notes(folder):
    return sorted(tuple(json.load(open(p))) for p in glob.glob(f"{folder}/*"))


def rows_of(answered):
    return sorted(map(tuple, answered.select(
        "path", "lang", "model", "answer_1", "answer_2").collect()))


def test_a_stopped_run_goes_on_where_it_was(spark, asked, tmp_path):
    whole, first, second = (str(tmp_path / n) for n in ("whole", "first", "second"))
    for folder in (whole, first, second):
        os.mkdir(folder)
    want = rows_of(resuming.answer_with_ledger(
        asked, logging_responder(whole), str(tmp_path / "ledger-1")))
    assert len(want) == 72 and want == rows_of(answering.answer_two_questions(
        asked, answering.make_plain_responder))
    assert len(notes(whole)) == len(set(notes(whole))) == 2 * 72

    ledger = str(tmp_path / "ledger-2")
    with pytest.raises(Exception, match="stopped"):
        resuming.answer_with_ledger(asked, logging_responder(first, 40), ledger, rows_per_round=20)
    kept = resuming.read_ledger(spark, ledger).count()
    assert 0 < kept < 72
    got = rows_of(resuming.answer_with_ledger(
        asked, logging_responder(second), ledger, rows_per_round=20))
    # Only what the ledger lacked is asked: first answers that it holds are the history.
    assert got == want and len(notes(second)) == len(set(notes(second))) == 2 * 72 - kept

    again = str(tmp_path / "again")
    os.mkdir(again)
    assert rows_of(resuming.answer_with_ledger(asked, logging_responder(again), ledger)) == want
    assert notes(again) == []


def test_ledger_keys(spark, asked, tmp_path):
    ledger, folder = str(tmp_path / "ledger"), str(tmp_path / "notes")
    os.mkdir(folder)
    twice = asked.unionByName(asked).withColumn("_at", F.lit("mine"))
    answered = resuming.answer_with_ledger(twice, logging_responder(folder), ledger)
    assert answered.count() == 144 and "_at" in answered.columns and len(notes(folder)) == 144
    # Another text of a question is another question.
    changed = asked.withColumn("question_1", F.concat("question_1", F.lit("!")))
    assert resuming.pending(changed, ledger, 1).count() == 72
    assert resuming.pending(asked, ledger, 1).count() == 0
    # Two runs at once: one answer counts.
    spark.read.schema(resuming.LEDGER).parquet(ledger).withColumns(
        {"run": F.lit("~"), "raw": F.lit("late")}).write.mode("append").parquet(ledger)
    assert resuming.read_ledger(spark, ledger).where("raw = 'late'").count() == 0
    with pytest.raises(Exception, match="a request needs"):
        resuming.pending(asked.withColumn("path", F.lit(None).cast("string")), ledger, 1).collect()
    assert resuming.answer_with_ledger(asked.where("false"), logging_responder(folder),
                                       str(tmp_path / "none")).collect() == []


def test_a_round_reads_its_own_rows_only(spark, asked, tmp_path, monkeypatch):
    plans, answer = [], resuming.answer_batches

    def noted(requests, *args, **options):
        plans.append(requests._jdf.queryExecution().executedPlan().toString())
        return answer(requests, *args, **options)

    monkeypatch.setattr(resuming, "answer_batches", noted)
    answered = resuming.answer_with_ledger(
        asked, answering.make_plain_responder, str(tmp_path / "ledger"), rows_per_round=20)
    assert len(plans) >= 2 * 4 and all(
        re.search(r"PartitionFilters: \[[^]]*_part", p) for p in plans)
    assert answered.count() == 72
    assert resuming.in_rounds({0: 9, 1: 12, 2: 8, 3: 30, 5: 1}, 20) == [[0], [1, 2], [3], [5]]
    assert resuming.in_rounds({}, 20) == []


SEVEN = ["id", "path", "dataset", "city", "subject", "answer_1", "answer_2"]


def answers_of(spark, texts, model="phi3"):
    rows = [(str(i), "p", "wiki", "c", "s", t, "b", model, "eng") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in [*SEVEN, "model", "lang"]))


def visible(folder):
    return sorted(p for p in glob.glob(f"{folder}/**/*", recursive=True)
                  if os.path.isfile(p) and "/_" not in p)


def test_a_run_is_appended_once_in_one_pass(spark, tmp_path):
    path, side, log = (str(tmp_path / n) for n in ("lines", "side", "log"))
    os.mkdir(log)

    @F.udf("string")
    def costly(text):
        open(f"{log}/{uuid.uuid4().hex}", "w").close()
        return text

    rows = answers_of(spark, ["x", "a|b", 'q "\\ é', "c\nd", ""]).withColumn(
        "answer_1", costly.asNondeterministic()("answer_1"))
    for run in ("r1", "r1", "r2"):
        answer_files.append_answer_lines(rows, path, side=side, run=run)
    assert len(os.listdir(log)) == 3 * 5  # once per row and append, for lines and side together
    lines = answer_files.read_answers(spark, path)
    assert sorted(r.answer_1 for r in lines.collect()) == sorted(2 * ["x", 'q "\\ é', ""])
    assert {(r.model, r.lang) for r in lines.collect()} == {("phi3", "eng")}
    unsafe = spark.read.parquet(side)
    assert sorted((r.answer_1, r.reason) for r in unsafe.collect()) == sorted(
        2 * [("a|b", "separator"), ("c\nd", "newline")])
    assert unsafe.columns == [*rows.columns, "reason"]
    assert not glob.glob(f"{path}/_staging/*") and not glob.glob(f"{side}/_staging/*")
    with pytest.raises(ValueError, match="a run is named"):
        answer_files.append_answer_lines(rows, path, side=side, run="a/b")


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path, side = str(tmp_path / "lines"), str(tmp_path / "side")
    rows = answers_of(spark, ["x", "a|b"] * 50).repartition(4)
    bad = rows.withColumn("answer_1", F.when(F.col("id") == "97", F.raise_error(
        F.lit("broken")).cast("string")).otherwise(F.col("answer_1")))
    with pytest.raises(Exception, match="broken"):
        answer_files.append_answer_lines(bad, path, side=side, run="r")
    assert visible(path) == visible(side) == []
    assert not glob.glob(f"{path}/_runs/*") and not glob.glob(f"{path}/_staging/*")
    answer_files.append_answer_lines(rows, path, side=side, run="r")
    assert answer_files.read_answers(spark, path).count() == 50
    assert spark.read.parquet(side).count() == 50


@pytest.mark.parametrize("folders", [[], ["model", "lang"]])
def test_a_task_that_writes_after_the_clearing_leaves_nothing(tmp_path, folders):
    path, side = str(tmp_path / "lines"), str(tmp_path / "side")
    for folder in (path, side):
        os.makedirs(f"{folder}/_staging/r-1")
    writer = once.OnceWriter({"path": f"file:{path}", "side": f"file:{side}", "run": "r",
                              "staging": "_staging/r-1", "folders": json.dumps(folders)})
    writer.abort([])
    for reason in (None, "separator"):
        batch = pa.RecordBatch.from_pydict({"model": ["m"], "lang": ["eng"], "_line": ["x"],
                                            "_reason": pa.array([reason], pa.string())})
        with pytest.raises(OSError):
            writer.write(iter([batch]))
    assert not glob.glob(f"{path}/_staging*/*") and not glob.glob(f"{side}/_staging*/*")


def test_moves_that_a_stopped_driver_left_are_made(spark, tmp_path, monkeypatch):
    path, side = str(tmp_path / "lines"), str(tmp_path / "side")
    os.makedirs(f"{path}/_staging/r-old/model=m/lang=eng")
    with open(f"{path}/_staging/r-old/model=m/lang=eng/r-1.txt", "w") as file:
        file.write("1|p|wiki|c|s|kept|b\n")
    os.makedirs(f"{path}/_runs")
    with open(f"{path}/_runs/r.json", "w") as file:
        name = "model=m/lang=eng/r-1.txt"
        json.dump({"staging": "_staging/r-old", "moves": [[False, f"_staging/r-old/{name}", name]]}, file)
    answer_files.append_answer_lines(answers_of(spark, ["other"]), path, side=side, run="r")
    assert [r.answer_1 for r in answer_files.read_answers(spark, path).collect()] == ["kept"]
    assert not glob.glob(f"{path}/_staging/*")


def test_folders_of_odd_values(spark, tmp_path):
    path, side = str(tmp_path / "a b"), str(tmp_path / "side")
    for i, model in enumerate(["x/y:z=%", "è é", None]):
        answer_files.append_answer_lines(
            answers_of(spark, ["t"], model), path, side=side, run=f"r{i}")
    got = {r.model for r in answer_files.read_answers(spark, path).collect()}
    assert got == {"x/y:z=%", "è é", None}
    assert once.folder_name("m", "") == once.folder_name("m", None)


def shape_model(log):
    def make():
        open(f"{log}/made-{uuid.uuid4().hex}", "w").close()

        def predict(tensor, number):
            assert tensor.shape[1:] == (2, 3) and number.shape == tensor.shape[:1]
            open(f"{log}/batch-{len(tensor)}-{uuid.uuid4().hex}", "w").close()
            return tensor.sum(axis=(1, 2)) * number
        return predict
    return make


def test_models_are_loaded_once_and_batches_are_bounded(spark, tmp_path):
    data = spark.range(0, 1000, 1, 40).select(
        "id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: i * F.col("id")).alias("tensor"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("number"))
    data = data.withColumn("tensor", F.when(F.col("id") % 11 == 5, F.lit(None)).when(
        F.col("id") % 13 == 5, F.array_append("tensor", F.lit(None).cast("long"))).otherwise(F.col("tensor")))
    scored = tensors.add_prediction(
        data, "score", {"tensor": (2, 3), "number": ()}, shape_model(str(tmp_path)), T.DoubleType(), 8)
    for r in scored.collect():
        known = r.id % 7 > 0 and r.id % 11 != 5 and r.id % 13 != 5
        assert r.score == (21.0 * r.id * (r.id % 3) if known else None)
    names = os.listdir(tmp_path)
    sizes = [int(n.split("-")[1]) for n in names if n.startswith("batch")]
    cores = spark.sparkContext.defaultParallelism
    assert sum(n.startswith("made") for n in names) <= 2 * cores < 40
    assert max(sizes) <= 8 and sum(sizes) == 1000
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_tensors_of_another_size_are_an_error(spark, tmp_path):
    data = spark.createDataFrame([([1.0] * 5, 1.0)], "tensor array<double>, number double")
    wrong = tensors.add_prediction(data, "score", {"tensor": (2, 3), "number": ()},
                                   shape_model(str(tmp_path)), T.DoubleType())
    with pytest.raises(Exception, match="expected 6 elements, not 5"):
        wrong.collect()
    assert tensors.add_prediction(data.where("false"), "score", {"tensor": (2, 3), "number": ()},
                                  shape_model(str(tmp_path)), T.DoubleType()).collect() == []


def test_feature_tensor(spark):
    row = spark.createDataFrame([(1, 2), (None, 2)], "a int, b int").select(
        tensors.feature_tensor("a", "b").alias("t")).collect()
    assert [r.t for r in row] == [[1.0, 2.0], None] and np.array(row[0].t).dtype == float
