"""Column functions against Python's own string methods on small inputs."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quizlens.functions import cleaning, outcomes as O, paths as P, text as T
from quizlens.values import DISPLAY_NAMES, WHITESPACE_CHARS


def one_column(spark, values, function):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = frame.select("i", function(F.col("v")).alias("v")).orderBy("i").collect()
    return [row.v for row in rows]


TEXTS = [
    None, "", " ", "a", " a ", "a\nb", "a \n\t b", "\r\na\r\n", "  a  b  ", "a\n\nb\n",
    *[f"{c}a{c}{c}b{c}" for c in WHITESPACE_CHARS],
    "x" + "".join(WHITESPACE_CHARS) + "y", "a\u200bb", "\ufeffa", "caffè \u2003 è",
]


def test_whitespace_set_is_pythons():
    assert set(WHITESPACE_CHARS) == {chr(i) for i in range(1, 0x10000) if chr(i).isspace()}


def test_strip_and_collapse_agree_with_python(spark):
    assert one_column(spark, TEXTS, T.strip_text) == [t if t is None else t.strip() for t in TEXTS]
    assert one_column(spark, TEXTS, T.collapse_ws) == [
        t if t is None else re.sub(r"\s+", " ", t) for t in TEXTS]
    assert one_column(spark, TEXTS, T.drop_newlines) == [
        t if t is None else re.sub(r"\s+", " ", t.replace("\n", "")) for t in TEXTS]


def test_every_bmp_code_point_collapses_as_in_python(spark):
    points = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF]
    joined = ["x".join(points[i:i + 4096]) for i in range(0, len(points), 4096)]
    assert one_column(spark, joined, T.collapse_ws) == [re.sub(r"\s+", " ", t) for t in joined]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t\u00a0\u2003\x1c\u3000é"), max_size=12), min_size=20))
def test_random_texts_collapse_as_in_python(spark, texts):
    assert one_column(spark, texts, T.collapse_ws) == [re.sub(r"\s+", " ", t) for t in texts]
    assert one_column(spark, texts, T.strip_text) == [t.strip() for t in texts]


def test_long_inner_run_of_blanks_is_linear(spark):
    text = " a" + " " * 2_000_000 + "b "
    assert one_column(spark, [text], T.strip_text) == [text.strip()]
    assert one_column(spark, [text], T.collapse_ws) == [" a b "]


def test_cut_at_marker(spark):
    texts = ["a<|end_of_text|>b<|end_of_text|>", "no marker", "<|end_of_text|>x", ""]
    assert one_column(spark, texts, T.cut_at_marker) == ["a", "no marker", "", ""]


def test_remove_echo_is_literal_and_complete(spark):
    prompt = F.lit("Which (one)?")
    texts = ["Which (one)? It is. Which (one)?", "[INST] Which (one)? [/INST] x", "Which one"]
    assert one_column(spark, texts, lambda c: T.remove_echo(c, prompt)) == [
        " It is. ", "[INST]  [/INST] x", "Which one"]
    assert one_column(spark, texts, lambda c: T.remove_wrapped_echo(c, prompt)) == [
        texts[0], "x", texts[2]]


@pytest.mark.parametrize("rendered", [0, 3, 6, 7, 8, 10, 30])
def test_drop_prefix_slices_as_python(spark, rendered):
    texts = ["", "abcdefghij", "aè\U0001f600cde"]
    assert one_column(spark, texts, lambda c: T.drop_prefix(c, F.lit(rendered))) == [
        t[rendered - 7:] for t in texts]


def test_record_line_keeps_null_fields(spark):
    frame = spark.createDataFrame([(1, None, " a ")], "i int, n string, s string")
    assert frame.select(T.record_line(*map(F.col, "ins"))).first()[0] == "1|| a "


def test_cleaning_recipe_order_and_unknown_model(spark):
    frame = spark.createDataFrame([("m1", "q a\nb q")], "model string, t string")
    cols = {"question_1": F.lit("q"), "question_2": F.lit("r"), "rendered_length": F.lit(7)}
    cleaned = lambda recipe: frame.select(
        cleaning.clean_by_model(F.col("t"), F.col("model"), recipe, cols)).first()[0]
    assert cleaned({"m1": ("echo_1", "newlines", "collapse")}) == " ab "
    assert cleaned({"m1": ("collapse", "echo_1")}) == " a b "
    with pytest.raises(Exception, match="no cleaning recipe"):
        cleaned({"m2": ("collapse",)})


PATHS = ["./dataset/i10_flore.jpg", "i1_flore.jpg", "./dataset/i7_wiki.jpeg",
         "a/b/i17_wiki_x.y.jpg", "./i3_other.JPG", "./ii4i_flore_wiki.png"]


def test_path_parts(spark):
    assert one_column(spark, PATHS, P.base_name) == [p.rsplit("/", 1)[-1] for p in PATHS]
    assert one_column(spark, PATHS, P.image_id) == [10, 1, 7, 17, 3, 4]
    assert one_column(spark, PATHS, P.source_class) == [
        "flore", "flore", "wiki", "wiki", "other", "wiki"]


def test_bad_paths_raise_only_when_strict(spark):
    bad = ["./dataset/readme.txt"]
    assert one_column(spark, bad, lambda c: P.image_id(c, strict=False)) == [None]
    assert one_column(spark, bad, lambda c: P.source_class(c, strict=False)) == [None]
    with pytest.raises(Exception, match="no picture id"):
        one_column(spark, bad, P.image_id)
    with pytest.raises(Exception, match="no source in file name"):
        one_column(spark, bad, P.source_class)


def test_image_suffix_ignores_case(spark):
    names = ["a.PNG", "a.jpg", "a.JpEg", "a.txt", "xjpg", None]
    assert one_column(spark, names, P.is_image) == [True, True, True, False, True, None]


def test_outcome_predicates_count_null_as_not_ok(spark):
    labels = ["OK", "NO", "ERR", "PAR", None]
    assert one_column(spark, labels, O.is_ok) == [True, False, False, False, False]
    assert one_column(spark, labels, O.not_ok) == [False, True, True, True, True]


def test_two_question_flag_is_or_of_both(spark):
    labels = ["OK", "NO", None]
    frame = spark.createDataFrame([(a, b) for a in labels for b in labels], "a string, b string")
    rows = frame.select("a", "b", O.is_ok_in_two(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == ((r.a == "OK") or (r.a != "OK" and r.b == "OK")) for r in rows)


def test_display_names(spark):
    raw = [f"{name}_{suffix}" for name in DISPLAY_NAMES for suffix in ("eng", "ITA")]
    found = one_column(spark, raw, lambda c: O.display_name(O.without_lang(c)))
    assert found == [v for v in DISPLAY_NAMES.values() for _ in range(2)]
    unknown = ["gpt_eng", "eng", None]
    loose = lambda c: O.display_name(O.without_lang(c), strict=False)
    assert one_column(spark, unknown, loose) == [None, None, None]
    with pytest.raises(Exception, match="no display name for: gpt"):
        one_column(spark, ["gpt_eng"], lambda c: O.display_name(O.without_lang(c)))


def test_picture_key(spark):
    frame = spark.createDataFrame(
        [("Bologna", "Torri/Portici"), (None, "x"), ("Roma", None)], "c string, s string")
    keys = [r[0] for r in frame.select(O.picture_key(F.col("c"), F.col("s"))).collect()]
    assert keys == ["Bologna / Torri", None, None]


def test_language_tag(spark):
    frame = spark.createDataFrame([("OK", "eng"), ("PAR", "ita")], "o string, l string")
    tags = [r[0] for r in frame.select(O.tag_language(F.col("o"), F.col("l"))).collect()]
    assert tags == ["OK (EN)", "PAR (IT)"]
