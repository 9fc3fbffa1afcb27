"""The registered queries, one per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quizlens import schemas
from quizlens.contract import inputs as I
from quizlens.functions import outcomes as O, text as X
from quizlens.functions.paths import base_name, image_id, source_class
from quizlens.operators import (
    answering,
    audit,
    differences,
    gallery,
    grading,
    metrics,
    ordering,
    requests,
    resuming,
    tensors,
    tiles,
)
from quizlens.plans import analyse, ask, keep_up
from quizlens.session import new_path
from quizlens.sources import (
    answers,
    catalogue as cat,
    graded as gr,
    headers,
    listing,
    ranges,
    tables,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- metrics -----------------------------------------------------------------

@query
def accuracy_by_dataset(spark, sf):
    return metrics.accuracy(grading.add_flags(I.graded(spark, sf)))


@query
def picture_outcomes_subject(spark, sf):
    return metrics.outcome_counts(I.graded(spark, sf, picture=True), ["lang", "picture"], "subject_1")


@query
def picture_outcomes_city(spark, sf):
    return metrics.outcome_counts(I.graded(spark, sf, picture=True), ["lang", "picture"], "city_1")


@query
def picture_outcomes_combo(spark, sf):
    return metrics.outcome_counts_by_language(I.graded(spark, sf, picture=True), "city_1")


@query
def outcome_counts(spark, sf):
    return metrics.outcome_counts(I.graded(spark, sf), ["algorithm"], "subject_2")


@query
def diff_language(spark, sf):
    return differences.language_difference(I.graded(spark, sf), names=I.NAMES)


@query
def diff_followup(spark, sf):
    return differences.followup_difference(I.graded(spark, sf), names=I.NAMES, langs=I.LANGS)


@query
def report_tables(spark, sf):
    """All tables of the full report in long form, all from its one stored cube."""
    enriched = grading.add_flags(I.graded(spark, sf, picture=True))
    long = []
    for name, table in analyse.report(enriched, names=I.NAMES).items():
        labels = [column for column, kind in table.dtypes if kind == "string"]
        numbers = [column for column in table.columns if column not in labels]
        long.append(table.select(
            F.lit(name).alias("table"), F.concat_ws(" | ", *labels).alias("key"),
            *[F.col(n).cast("double").alias(n) for n in numbers],
        ).unpivot(["table", "key"], numbers, "measure", "value"))
    return gr.combine(long)


@query
def report_kept_up(spark, sf):
    """Accuracy from a ledger of files that grew in two steps, a third of them replaced."""
    folder, ledger = new_path(spark, "graded"), new_path(spark, "ledger")
    rows, third = I.graded_file(spark, sf), F.col("id") % 3
    enriched = lambda r: grading.add_flags(r).withColumns({
        "algorithm": O.without_lang(F.col("model")), "picture": F.col("path")})
    steps = [("a", rows.where(third == 0)), ("b", rows.where(third == 1).limit(0)),
             ("b", rows.where(third == 1)), ("c", rows.where(third == 2))]
    for name, part in steps:
        tables.write_graded(part, f"{folder}/{name}")
        keep_up.update(spark, folder, ledger, enriched=enriched)
    cubes = keep_up.current_cubes(spark, folder, ledger).where("cube = 'model'")
    return metrics.accuracy(grading.add_flags(cubes), weight="answers")


# --- outcome predicates and labels ---------------------------------------------

@query
def flag_ok(spark, sf):
    return I.docgraded(spark, sf).select(
        "doc_id", "subject_1", "city_1",
        O.is_ok(F.col("subject_1")).alias("subject_ok"), O.is_ok(F.col("city_1")).alias("city_ok"))


@query
def flag_ok_2q(spark, sf):
    rows = I.graded(spark, sf)
    return rows.select("algorithm", "dataset", "lang", "subject_1", "subject_2", O.is_ok_in_two(
        F.col("subject_1"), F.col("subject_2")).alias("subject_ok_2q"))


@query
def filter_not_ok(spark, sf):
    return grading.not_ok_rows(I.docgraded(spark, sf)).select("doc_id", "algorithm", "subject_1")


@query
def exclude_paths(spark, sf):
    excluded = ["./dataset/i2_flore.jpg", "./dataset/i3_other.jpg", "./dataset/i6_wiki_hot-gear.jpg"]
    return grading.exclude_paths(I.images(spark, sf), excluded).select("image_id", "path")


@query
def map_display_name(spark, sf):
    rows = I.graded_file(spark, sf).select("model")
    name = O.display_name(O.without_lang(F.col("model")), I.DISPLAY)
    return rows.select("model", name.alias("algorithm")).groupBy("model", "algorithm").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"))


@query
def picture_key(spark, sf):
    rows = I.graded_file(spark, sf)
    key = O.picture_key(F.nullif(F.col("city"), F.lit("City 3")), F.col("subject"))
    return rows.select("path", "dataset", key.alias("picture"))


# --- audit ---------------------------------------------------------------------

@query
def audit_domains(spark, sf):
    return audit.label_domains(
        I.graded(spark, sf), ["city_1", "subject_1", "subject_2"], by=["lang"])


@query
def audit_nulls(spark, sf):
    return audit.null_counts(I.docgraded(spark, sf), ["city_1", "subject_1"], by=["dataset"])


@query
def audit_null_rows(spark, sf):
    return audit.null_rows(I.docgraded(spark, sf), "subject_1")


# --- text and paths ------------------------------------------------------------

@query
def parse_path(spark, sf):
    path = F.col("path")
    return I.images(spark, sf).select(
        "image_id", base_name(path).alias("file"), image_id(path).alias("id"),
        source_class(path).alias("dataset"))


@query
def strip_text(spark, sf):
    padded = F.concat(F.lit("\u00a0\u2003 "), F.col("text"), F.lit("\u3000\x1c\n"))
    return I.turns(spark, sf).select("conv_id", "turn", X.strip_text(padded).alias("text"))


@query
def collapse_ws(spark, sf):
    spaced = F.replace(F.col("text"), F.lit(" a"), F.lit("\u2003\u00a0\x1ea"))
    return I.table(spark, sf, "documents").select("doc_id", X.collapse_ws(spaced).alias("text"))


@query
def drop_newlines(spark, sf):
    return I.turns(spark, sf).select("conv_id", "turn", X.drop_newlines(F.col("text")).alias("text"))


@query
def cut_at_marker(spark, sf):
    url = F.col("url")
    return I.table(spark, sf, "pages").select(
        "page_id", X.cut_at_marker(url, "?").alias("address"),
        base_name(X.cut_at_marker(X.cut_at_marker(url, "#"), "?")).alias("file"),
        X.cut_at_marker(F.concat("html", F.lit("<|end_of_text|>"), url)).alias("html"))


@query
def remove_echo(spark, sf):
    text, role = F.col("text"), F.col("role")
    echoed = F.concat(F.lit("[INST] "), role, F.lit(" [/INST] "), text, F.lit(" "), role)
    return I.turns(spark, sf).select(
        "conv_id", "turn", X.remove_echo(echoed, role).alias("no_echo"),
        X.remove_wrapped_echo(echoed, role).alias("no_wrapped_echo"))


@query
def drop_prefix(spark, sf):
    rendered = F.length("text") % 20
    return I.turns(spark, sf).select(
        "conv_id", "turn", X.drop_prefix(F.col("text"), rendered).alias("text"))


# --- requests, dialogues, answers ------------------------------------------------

def _pictures(spark, sf):
    return requests.add_subject(requests.parse_listing(I.images(spark, sf)), I.catalogue(spark, sf))


def _model_requests(spark, sf):
    pairs = requests.pair_requests(_pictures(spark, sf), I.LANGS)
    return requests.add_policy(pairs.withColumn("model", I.model_of(F.col("image_id"))))


@query
def lookup_catalogue(spark, sf):
    return _pictures(spark, sf).select("image_id", "id", "city", "subject")


@query
def build_requests(spark, sf):
    return requests.build_requests(_pictures(spark, sf), I.LANGS).select(
        "image_id", "path", "lang", "question_no", "question")


@query
def dialogue_turn1(spark, sf):
    asked = requests.ask_first(_model_requests(spark, sf))
    return requests.flatten_dialogue(asked, "dialogue_1", ["image_id", "model", "lang"])


@query
def dialogue_turn2(spark, sf):
    answered = _model_requests(spark, sf).withColumn("answer_1", F.concat(F.lit("It is "), "subject"))
    asked = requests.ask_second(answered)
    return requests.flatten_dialogue(asked, "dialogue_2", ["image_id", "model", "lang"])


@query
def answer_stub(spark, sf):
    answered = answering.answer_two_questions(
        ask.spread(_model_requests(spark, sf)), answering.make_plain_responder)
    return answered.select("image_id", "model", "lang", "answer_1", "answer_2")


@query
def answer_resumed(spark, sf):
    """A run over a third of the pictures, and one over all that asks only the rest."""
    asked, ledger = _model_requests(spark, sf), new_path(spark, "ledger")
    for part in (asked.where(F.col("image_id") % 3 == 0), asked):
        # Pictures of one name are one picture to the ledger, so the key is in the path.
        part = part.withColumn("path", F.concat("path", F.lit("?"), F.col("image_id")))
        answered = resuming.answer_with_ledger(part, answering.make_plain_responder, ledger)
    return answered.select("image_id", "model", "lang", "answer_1", "answer_2")


def _make_shape_model():
    """A plain layer and a sum, in whole numbers, so that any order of sums is exact."""
    weights, shift = np.array([[3.0, -4.0, 1.0], [-3.0, 4.0, 1.0]]), np.array([0.0, 0.0, -1500.0])

    def predict(sizes):
        hidden = np.maximum(sizes @ weights + shift, 0.0)
        return np.concatenate([hidden, hidden.sum(axis=1, keepdims=True)], axis=1)

    return predict


@query
def predict_shapes(spark, sf):
    """How wide, tall and large a picture is to a small numeric model."""
    sizes = I.images(spark, sf).withColumn("size", F.when(
        F.col("image_id") % 17 > 0, tensors.feature_tensor("width", "height")))
    scored = tensors.add_prediction(
        sizes, "scores", {"size": (2,)}, _make_shape_model, T.ArrayType(T.DoubleType()))
    names = ("wide", "tall", "large", "total")
    return scored.select("image_id", *[F.get("scores", F.lit(i)).alias(n)
                                       for i, n in enumerate(names)])


def _answers(spark, sf):
    """Answers with quotes, backslashes and outer blanks, as models give them."""
    pictures = _pictures(spark, sf)
    return pictures.withColumns({
        "answer_1": F.concat(F.lit(' "A '), "subject", F.lit('", \\n ')),
        "answer_2": F.when(F.col("image_id") % 3 > 0, F.concat(F.lit("In "), "city", F.lit(" "))),
    })


@query
def answer_rows(spark, sf):
    return answering.answer_rows(_answers(spark, sf))


@query
def two_turn_pivot(spark, sf):
    return answering.two_turn_pairs(I.turns(spark, sf))


# --- tiles -----------------------------------------------------------------------

@query
def tile_candidates(spark, sf):
    return tiles.grid_usage(I.images(spark, sf)).select("cols", "rows", "area", "images")


@query
def tile_grid(spark, sf):
    return tiles.plan_grids(I.images(spark, sf)).select(
        "image_id", "width", "height", "cols", "rows", "blocks", "target_w", "target_h")


@query
def tile_boxes(spark, sf):
    return tiles.tile_boxes(tiles.plan_grids(I.images(spark, sf))).select(
        "image_id", "tile", "x0", "y0", "x1", "y1", "is_thumbnail")


# --- gallery and order -----------------------------------------------------------

def _gallery(spark, sf):
    return gallery.gallery_files(I.images(spark, sf), excluded=I.GALLERY_EXCLUDED)


@query
def gallery_filter(spark, sf):
    return _gallery(spark, sf).select("image_id", "file", "source", "source_order")


@query
def gallery_labels(spark, sf):
    labelled = gallery.caption_files(_gallery(spark, sf), I.catalogue(spark, sf))
    return labelled.select("image_id", "file", "source", "label")


@query
def gallery_grid(spark, sf):
    sheet = gallery.place_in_grid(_gallery(spark, sf), "image_id")
    return gallery.caption_files(sheet, I.catalogue(spark, sf)).select(
        "position", "grid_row", "grid_col", "source", "file", "label")


@query
def combined_sorted(spark, sf):
    """With places in the order, which rows alone would not show."""
    rows = I.graded_file(spark, sf).select("path", "model", "lang", "answer_1", "subject_1")
    return ordering.with_position(rows, ["path", "model", "answer_1"], "place")


@query
def indexed_table(spark, sf):
    counts = metrics.outcome_counts(I.graded(spark, sf, picture=True), ["picture"], "subject_1")
    return ordering.with_position(counts, ["picture", "subject_1"])


# --- sources and sinks -----------------------------------------------------------

@query
def scan_catalogue(spark, sf):
    path = new_path(spark, "catalogue")
    tables.write_table(I.catalogue(spark, sf).select("id", "subject", "city", "flore", "wiki", "other"),
                       path, sep=";")
    return cat.source_flags(cat.read_catalogue(spark, path))


def _text_files(spark, sf):
    """A folder of text files in one folder per language, none of them very large."""
    folder = new_path(spark, "texts")
    texts = I.table(spark, sf, "documents").select("lang", "text")
    texts.write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(folder)
    return folder


def _folder_lang():
    return F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")


@query
def scan_listing(spark, sf):
    files = listing.list_files(spark, _text_files(spark, sf), "*.txt", recursive=True)
    return files.groupBy(_folder_lang()).agg(F.sum("length").alias("bytes"))


@query
def scan_tree(spark, sf):
    """The same files, listed by tasks."""
    files = listing.list_tree(spark, _text_files(spark, sf), "*.txt")
    return files.groupBy(_folder_lang()).agg(F.sum("length").alias("bytes"))


@query
def scan_bytes(spark, sf):
    files = listing.read_bytes(spark, _text_files(spark, sf), "*.txt", recursive=True)
    lines = F.size(F.split(F.decode("content", "utf-8"), "\n")) - 1
    return files.groupBy(_folder_lang()).agg(
        F.sum(F.length("content")).cast("bigint").alias("bytes"),
        F.sum(lines).cast("bigint").alias("lines"))


@query
def scan_graded(spark, sf):
    folder = new_path(spark, "graded")
    tables.write_graded(I.graded_file(spark, sf), folder)
    scanned = gr.read_graded(spark, folder)
    return scanned.withColumn("score", gr.score_value(F.col("score_1")))


@query
def combine_graded(spark, sf):
    rows = I.graded_file(spark, sf)
    english = rows.where(F.col("lang") == "eng").drop("note", "score_1")
    return gr.combine([rows.where(F.col("lang") == "ita"), english]).select(
        "path", "model", "subject_1", "score_1", "note")


@query
def scan_ranges(spark, sf):
    """Files with quoted line breaks, by small ranges of their bytes."""
    folder = new_path(spark, "graded")
    tables.write_graded(I.graded_file(spark, sf), folder)
    scanned = ranges.read_graded_ranges(spark, folder, range_bytes=1 << 18)
    return scanned.withColumn("score", gr.score_value(F.col("score_1")))


@query
def combine_unlike(spark, sf):
    """Three kinds of files in one folder: all columns, fewer, and in another order."""
    folder, rows = new_path(spark, "unlike"), I.graded_file(spark, sf).drop("lang")
    number, names = F.col("id") % 3, {n: h for h, n in schemas.GRADED_HEADER.items()}
    kinds = [rows.columns, [c for c in rows.columns if c not in ("note", "score_1")],
             [c for c in reversed(rows.columns) if c != "description_2"]]
    for at, kind in enumerate(kinds):
        part = rows.where(number == at).select(*[F.col(c).alias(names[c]) for c in kind])
        tables.write_table(part, f"{folder}/{at}", sep="\t")
    return headers.read_unlike(spark, folder, schemas.GRADED_HEADER, schemas.GRADED, "\t", "*.csv",
                               recursive=True).drop(headers.FILE)


@query
def roundtrip_combined(spark, sf):
    path = new_path(spark, "combined")
    tables.write_combined(I.graded_file(spark, sf), path)
    return gr.read_combined(spark, path)


def _appended(spark, sf, *runs):
    """Answers appended once per run: lines per model and language, and the answers
    that no line can hold."""
    path, side = new_path(spark, "answers"), new_path(spark, "unsafe")
    number = F.col("image_id")
    rows = _answers(spark, sf).withColumns({
        "id": F.col("id_text"), "model": I.model_of(number), "lang": F.when(number % 2 == 0, "ita").otherwise("eng"),
        "answer_1": F.when(number % 11 == 0, F.concat("answer_1", F.lit("|")))
        .when(number % 13 == 0, F.concat("answer_1", F.lit("\n"))).otherwise(F.col("answer_1"))})
    for run in runs:
        answers.append_answer_lines(rows, path, side=side, run=run)
    lines = answers.read_answers(spark, path).withColumn("reason", F.lit(None).cast("string"))
    unsafe = spark.read.schema(rows.schema.add("reason", "string")).parquet(side)
    return lines.unionByName(unsafe.select(lines.columns))


@query
def roundtrip_answers(spark, sf):
    return _appended(spark, sf, None, None)


@query
def append_once(spark, sf):
    """A run that is repeated adds its answers once; another run adds its own."""
    return _appended(spark, sf, "monday", "monday", "tuesday", "monday")


@query
def append_answers(spark, sf):
    path = new_path(spark, "answers")
    rows = _answers(spark, sf).withColumns(
        {"model": I.model_of(F.col("image_id")), "lang": F.lit("ita")})
    for _ in range(2):
        answers.append_answers(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select(
        "model", "lang", "image_id", "path", "answer_1", "answer_2")


@query
def roundtrip_table(spark, sf):
    path = new_path(spark, "table")
    table = metrics.accuracy(grading.add_flags(I.graded(spark, sf)))
    tables.write_table(table, path, index_keys=["algorithm", "dataset"])
    return spark.read.schema(
        "index bigint, algorithm string, dataset string, subject_accuracy double, "
        "city_accuracy double, subject_accuracy_2q double"
    ).option("header", True).csv(path)
