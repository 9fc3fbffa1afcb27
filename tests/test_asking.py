"""Requests, dialogues and two-question answering for every model's settings."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizlens.operators import answering, requests
from quizlens.plans import ask as ask_plan
from quizlens.sources import answers as answer_files
from quizlens.sources.listing import load_bytes
from quizlens.values import POLICIES, PROMPTS

PICTURE_FIRST = {"deepseekvl", "internvl2", "phi3", "qwen2vl", "smolvlm"}
Q1, Q2 = PROMPTS["eng"][1], PROMPTS["eng"][2].replace("CITY", "Roma")


@pytest.fixture(scope="module")
def pictures(spark):
    listing = spark.createDataFrame([("./dataset/i1_flore.jpg",), ("./dataset/i2_wiki_x.jpeg",)], "path string")
    catalogue = spark.createDataFrame(
        [(1, " Arena ", "Roma "), (2, "Duomo", "\tNapoli")], "id int, subject string, city string")
    return requests.add_subject(requests.parse_listing(listing), catalogue)


@pytest.fixture(scope="module")
def all_models(spark, pictures):
    models = spark.createDataFrame([(p.model,) for p in POLICIES], "model string")
    pairs = requests.pair_requests(pictures.where("id = 1"))
    return requests.add_policy(pairs.join(models))


def plain(dialogue):
    return [(t.role, [(p.type, p.text or p.image or "") for p in t.content]) for t in dialogue]


def test_subject_is_stripped_and_requests_filled(pictures):
    assert Counter((r.id, r.dataset, r.city, r.subject) for r in pictures.collect()) == Counter(
        [(1, "flore", "Roma", "Arena"), (2, "wiki", "Napoli", "Duomo")])
    long = requests.build_requests(pictures, ["ita", "eng"]).collect()
    assert len(long) == 8
    assert {r.question for r in long if r.id == 1 and r.lang == "eng"} == {Q1, Q2}
    default = requests.build_requests(pictures)
    assert {r.lang for r in default.collect()} == {"eng"}


def test_slot_is_filled_everywhere_and_only_the_slot(spark):
    frame = spark.createDataFrame([("CITY and CITY, City", "Roma")], "t string, c string")
    assert frame.select(requests.fill_city(F.col("t"), F.col("c"))).first()[0] == "Roma and Roma, City"


def test_unknown_catalogue_id_raises(spark):
    listing = spark.createDataFrame([("./i9_flore.jpg",)], "path string")
    catalogue = spark.createDataFrame([(1, "a", "b")], "id int, subject string, city string")
    with pytest.raises(Exception, match="expected one row for id 9"):
        requests.add_subject(requests.parse_listing(listing), catalogue).collect()


def test_first_dialogue(all_models):
    picture = ("image", "./dataset/i1_flore.jpg")
    for row in requests.ask_first(all_models).collect():
        expected = [("user", [picture, ("text", Q1)] if row.model in PICTURE_FIRST else
                     [("text", Q1), picture])]
        if row.model == "deepseekvl":
            expected.append(("assistant", [("text", "")]))
        assert plain(row.dialogue_1) == expected


def test_second_dialogue_follows_each_models_settings(all_models):
    asked = requests.ask_second(all_models.withColumn("answer_1", F.lit("A")))
    picture = ("image", "./dataset/i1_flore.jpg")
    blank = ("assistant", [("text", "")])
    usual = [("user", [("text", Q1), picture]), ("assistant", [("text", "A")]), ("user", [("text", Q2)])]
    turned = [("user", [picture, ("text", Q1)]), *usual[1:]]
    expected = {
        "cogvlm2": [("user", [("text", Q1)]), *usual[1:]],
        "deepseekvl": [turned[0], blank, *turned[1:], blank],
        "internvl2": turned,
        "llava1.6": usual,
        "molmo": [("user", [("text", Q2), picture])],
        "phi3": [("user", [picture, ("text", Q2)])],
        "pixtral": usual,
        "qwen2vl": turned,
        "smolvlm": turned,
    }
    assert {r.model: plain(r.dialogue_2) for r in asked.collect()} == expected


def test_unknown_model_raises(pictures):
    pairs = requests.pair_requests(pictures).withColumn("model", F.lit("other"))
    with pytest.raises(Exception, match="no settings for model: other"):
        requests.add_policy(pairs).collect()


def test_dialogue_and_pivot_are_inverse(spark, all_models):
    asked = requests.ask_second(all_models.where("history and not blank_turn").withColumns(
        {"answer_1": F.lit("A"), "conv_id": F.monotonically_increasing_id()}))
    turns = requests.flatten_dialogue(asked, "dialogue_2", ["conv_id"]).where("type = 'text'")
    pairs = answering.two_turn_pairs(turns.withColumnRenamed("turn_no", "turn")).collect()
    assert len(pairs) == asked.count()
    assert {(r.question_1, r.answer_1, r.question_2, r.answer_2) for r in pairs} == {(Q1, "A", Q2, None)}


def test_pivot_of_one_very_long_dialogue(spark):
    turns = spark.range(30_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user")
        .otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    pairs = answering.two_turn_pairs(turns)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle, once after
    assert tuple(pairs.first()) == (1, "t1", "t2", "t3", "t4")


def make_echoing_responder():
    def respond(batch):
        found = []
        for turns in batch["dialogue"]:
            said = [p["text"] for t in turns if t["role"] == "assistant" for p in t["content"]]
            asked = [p["text"] for t in turns if t["role"] == "user" for p in t["content"]
                     if p["type"] == "text"]
            found.append((f"[INST] {asked[-1]} [/INST] A\n\nB<|end_of_text|>{'+'.join(said)}", 7))
        return found
    return respond


def test_answers_are_cleaned_and_remembered_by_model(all_models):
    rows = answering.answer_two_questions(all_models, make_echoing_responder).collect()
    first = {r.model: r.answer_1 for r in rows}
    second = {r.model: r.answer_2 for r in rows}
    collapsed = f"[INST] {Q1} [/INST] A B<|end_of_text|>"
    raw = f"[INST] {Q1} [/INST] A\n\nB<|end_of_text|>"
    assert first == {p.model: collapsed for p in POLICIES} | {
        "cogvlm2": f"[INST] {Q1} [/INST] A B",
        "llava1.6": "A B<|end_of_text|>",
        "phi3": raw,
        "pixtral": "[INST] [/INST] A B<|end_of_text|>",
    }
    head = f"[INST] {Q2} [/INST] A B<|end_of_text|>"
    # The sampled text repeats what the model was told, so it shows the history.
    assert second["qwen2vl"] == head + collapsed
    assert second["internvl2"] == head + collapsed
    assert second["smolvlm"] == head + collapsed  # told the raw text, then collapsed
    assert second["deepseekvl"] == head + "+" + collapsed + "+"
    assert second["molmo"] == head
    assert second["phi3"] == f"[INST] {Q2} [/INST] A\n\nB<|end_of_text|>"
    assert second["cogvlm2"] == f"[INST] {Q2} [/INST] A B"
    assert second["llava1.6"] == head + "A B<|end_of_text|>"
    assert second["pixtral"] == "[INST] [/INST] AB<|end_of_text|>[INST] [/INST] A B<|end_of_text|>"


def test_raw_history_reaches_the_second_question(all_models):
    def make():
        def respond(batch):
            return [(str(sum(len(p["text"]) for t in d if t["role"] == "assistant"
                             for p in t["content"])) + "  ..", 7) for d in batch["dialogue"]]
        return respond
    rows = {r.model: r.answer_2 for r in answering.answer_two_questions(all_models, make).collect()}
    assert rows["smolvlm"] == "5 .."  # "0  .." as it came
    assert rows["qwen2vl"] == "4 .."  # "0 .." after cleaning


def test_rendered_length_cuts_the_repeated_request(all_models):
    llava = all_models.where("model = 'llava1.6'")

    def rendered(dialogue):
        return "".join(f"{t['role']}: {p['text'] or '<image>'} " for t in dialogue for p in t["content"])

    def make():
        # The request is longer by the first answer, and 7 characters of it are not repeated.
        return lambda batch: [(rendered(d)[7:] + f"answer {len(d)}", len(rendered(d)))
                              for d in batch["dialogue"]]

    assert answering.answer_two_questions(llava, make).first().answer_2 == "answer 3"


def test_missing_rendered_length_raises_where_it_is_needed(all_models):
    make = lambda: lambda batch: ["x"] * len(batch)
    with pytest.raises(Exception, match="no length of the request"):
        answering.answer_two_questions(all_models.where("model = 'llava1.6'"), make).collect()
    assert answering.answer_two_questions(
        all_models.where("model = 'molmo'"), make).first().answer_2 == "x"


def counting_responder(folder):
    """Writes a file for every make and one for every batch, named by its rows.

    A responder outlives its task, so accumulators of a task would miss later ones.
    """
    def make():
        import os
        import uuid
        open(os.path.join(folder, f"made-{uuid.uuid4()}"), "w").close()

        def respond(batch):
            open(os.path.join(folder, f"batch-{len(batch)}-{uuid.uuid4()}"), "w").close()
            return [("x", 7)] * len(batch)
        return respond
    return make


def counted(folder):
    names = [p.name.split("-") for p in folder.iterdir()]
    return (sum(n[0] == "made" for n in names), sum(n[0] == "batch" for n in names),
            sum(int(n[1]) for n in names if n[0] == "batch"))


def test_one_responder_per_worker_process_serves_both_turns(spark, all_models, tmp_path):
    make = counting_responder(str(tmp_path))

    many = all_models.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).repartition(40)
    answering.answer_two_questions(many, make).write.format("noop").mode("overwrite").save()
    made, batches, asked = counted(tmp_path)
    cores = spark.sparkContext.defaultParallelism
    assert 1 <= made <= 2 * cores < 40 < batches and asked == 2 * 40 * len(POLICIES)


def test_rows_per_task(spark):
    cores = spark.sparkContext.defaultParallelism
    assert ask_plan.spread(spark.range(1000), 10).rdd.getNumPartitions() == 100
    assert ask_plan.spread(spark.range(5), 10).rdd.getNumPartitions() == cores


def test_spreading_holds_no_whole_listing_in_a_task(spark):
    """One partition goes to 500 tasks: unsorted, and by way of few partitions."""
    same = spark.range(5000).coalesce(1).select(F.lit("same").alias("path"), "id")
    dealt = ask_plan.spread(same, 10)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert dealt.columns == ["path", "id"] and dealt.rdd.getNumPartitions() == 500
    assert sorted(r.id for r in dealt.collect()) == list(range(5000))
    most = ask_plan.spread(same.select("path"), 10).groupBy(F.spark_partition_id()).count()
    assert most.agg(F.max("count")).first()[0] < 50


def test_each_request_is_answered_once(all_models, tmp_path):
    make = counting_responder(str(tmp_path))
    answering.answer_two_questions(all_models, make).write.format("noop").mode("overwrite").save()
    assert counted(tmp_path)[2] == 2 * len(POLICIES)


def test_wrong_number_of_answers_is_an_error(all_models):
    with pytest.raises(Exception):
        answering.answer_two_questions(all_models, lambda: lambda batch: ["x"]).collect()


def test_ask_from_folder_to_files(spark, tmp_path):
    folder = tmp_path / "dataset"
    folder.mkdir()
    for name in ("i1_flore.jpg", "i2_wiki.jpeg", "i2_other_b.jpg"):
        (folder / name).write_bytes(b"not a picture")
    (tmp_path / "catalogue.csv").write_text(
        "id;subject;city;flore;wiki;other\n1;Arena ;Verona;x;;\n2; Duomo;Milano ;;x;x\n", encoding="utf8")
    found = ask_plan.ask(spark, str(folder), str(tmp_path / "catalogue.csv"), "cogvlm2",
                         answering.make_plain_responder, langs=["ita"])
    out, lines = str(tmp_path / "answers"), str(tmp_path / "lines")
    ask_plan.save(found, out, lines)
    stored = spark.read.parquet(out)
    assert {(r.model, r.lang) for r in stored.collect()} == {("cogvlm2", "ita")}
    read = answer_files.read_answers(spark, lines).orderBy("path").collect()
    assert [(r.id, r.path, r.dataset, r.city, r.subject) for r in read] == [
        ("1", "./dataset/i1_flore.jpg", "flore", "Verona", "Arena"),
        ("2", "./dataset/i2_other_b.jpg", "other", "Milano", "Duomo"),
        ("2", "./dataset/i2_wiki.jpeg", "wiki", "Milano", "Duomo")]
    assert read[0].answer_2.startswith("Sei a Verona, qual è")
    seen = ask_plan.ask(spark, str(folder), str(tmp_path / "catalogue.csv"), "molmo",
                        lambda: lambda batch: [load_bytes(uri).decode() for uri in batch["uri"]])
    assert {(r.answer_1, r.answer_2) for r in seen.collect()} == {("not a picture", "not a picture")}
    ask_plan.save(found, out, lines)
    assert spark.read.parquet(out).count() == 6
    back = answer_files.read_answers(spark, lines).collect()
    assert len(back) == 6 and {(r.model, r.lang) for r in back} == {("cogvlm2", "ita")}


def test_manifest_ids_as_written_and_unsafe_answers(spark, tmp_path):
    (tmp_path / "catalogue.csv").write_text(
        "id;subject;city;flore;wiki;other\n1;Arena;Verona;x;;\n2;Duomo;Milano;;x;x\n", encoding="utf8")
    manifest = spark.createDataFrame(
        [("./dataset/i01_wiki.jpg", "s3://b/1"), ("./dataset/i2_other.jpg", "s3://b/2")],
        "path string, uri string")
    make = lambda: lambda batch: ["a|b" if "i2" in p else "fine" for p in batch["path"]]
    out, lines = str(tmp_path / "answers"), str(tmp_path / "lines")
    ask_plan.save(ask_plan.ask(spark, manifest, str(tmp_path / "catalogue.csv"), "phi3", make,
                               ["ita", "eng"]), out, lines)
    assert spark.read.parquet(out).count() == 4
    read = answer_files.read_answers(spark, lines).collect()
    assert {(r.id, r.model, r.lang, r.subject) for r in read} == {
        ("01", "phi3", "ita", "Arena"), ("01", "phi3", "eng", "Arena")}
    unsafe = spark.read.parquet(lines + "-unsafe").collect()
    assert [(r.id, r.reason, r.answer_1) for r in unsafe] == [("2", "separator", "a|b")] * 2
