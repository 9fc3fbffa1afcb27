"""Question requests: pictures, their subject, and what each model is asked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quizlens.functions.dialogue import first_dialogue, second_dialogue
from quizlens.functions.paths import image_id, image_id_text, source_class
from quizlens.functions.text import strip_text
from quizlens.operators.lookups import lookup
from quizlens.values import CITY_SLOT, DEFAULT_LANG, POLICIES, PROMPTS, ModelPolicy


def parse_listing(listing: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``id``, its text as written and ``dataset`` from the file name."""
    path = F.col("path")
    return listing.withColumns({"id": image_id(path, strict), "id_text": image_id_text(path),
                                "dataset": source_class(path, strict)})


def add_subject(pictures: DataFrame, catalogue: DataFrame, strict: bool = True) -> DataFrame:
    """Add the stripped city and subject of each picture's catalogue id."""
    found = lookup(pictures, catalogue, "id", "id", ["city", "subject"], strict)
    return found.withColumns({
        "city": strip_text(F.col("city")),
        "subject": strip_text(F.col("subject")),
    })


def fill_city(template: Column, city: Column) -> Column:
    """Put the city into every slot of the question."""
    return F.replace(template, F.lit(CITY_SLOT), city)


def build_requests(pictures: DataFrame, langs: Sequence[str] = (DEFAULT_LANG,),
                   prompts: Mapping[str, Mapping[int, str]] = PROMPTS) -> DataFrame:
    """One row per picture, language and question.

    The questions are a short literal list that each row unfolds in place.
    """
    asked = [
        F.struct(F.lit(lang).alias("lang"), F.lit(number).alias("question_no"),
                 F.lit(template).alias("template"))
        for lang in langs for number, template in prompts[lang].items()
    ]
    return pictures.select("*", F.inline(F.array(*asked))).withColumn(
        "question", fill_city(F.col("template"), F.col("city"))).drop("template")


def pair_requests(pictures: DataFrame, langs: Sequence[str] = (DEFAULT_LANG,),
                  prompts: Mapping[str, Mapping[int, str]] = PROMPTS) -> DataFrame:
    """One row per picture and language, with both questions side by side."""
    asked = [
        F.struct(F.lit(lang).alias("lang"), F.lit(prompts[lang][1]).alias("question_1"),
                 F.lit(prompts[lang][2]).alias("question_2"))
        for lang in langs
    ]
    city = F.col("city")
    unfolded = pictures.select("*", F.inline(F.array(*asked)))
    return unfolded.withColumns({
        "question_1": F.col("question_1"),
        "question_2": fill_city(F.col("question_2"), city),
    })


def add_policy(requests: DataFrame, policies: Sequence[ModelPolicy] = POLICIES) -> DataFrame:
    """Add each model's settings from a literal map with one entry per known model.

    A model without an entry raises.
    """
    settings = {"history": "boolean", "image_in_turn_2": "boolean", "image_first": "boolean",
                "blank_turn": "boolean", "raw_history": "boolean", "max_new_tokens": "int", "decoding": "string"}
    entries = []
    for policy in policies:
        entries.append(F.lit(policy.model))
        entries.append(F.struct(*[F.lit(getattr(policy, s)).alias(s) for s in settings]))
    found = F.create_map(*entries)[F.col("model")]
    problem = F.concat(F.lit("no settings for model: "), F.coalesce("model", F.lit("null")))
    return requests.withColumn("_policy", found).withColumns({
        s: F.coalesce(F.col("_policy")[s], F.raise_error(problem).cast(kind))
        for s, kind in settings.items()
    }).drop("_policy")


def ask_first(requests: DataFrame, image: str = "path") -> DataFrame:
    """Add ``dialogue_1``: the request for the first answer."""
    return requests.withColumn("dialogue_1", first_dialogue(
        F.col("question_1"), F.col(image), F.col("blank_turn"), F.col("image_first")))


def ask_second(requests: DataFrame, answer: str = "answer_1", image: str = "path") -> DataFrame:
    """Add ``dialogue_2``: the request for the second answer, by the model's settings."""
    return requests.withColumn("dialogue_2", second_dialogue(
        F.col("question_1"), F.col(answer), F.col("question_2"), F.col(image),
        F.col("history"), F.col("image_in_turn_2"), F.col("blank_turn"), F.col("image_first")))


def flatten_dialogue(data: DataFrame, dialogue: str, keys: Sequence[str]) -> DataFrame:
    """One row per part of each turn of a dialogue."""
    turns = data.select(*keys, F.posexplode(dialogue).alias("turn_no", "_turn"))
    return turns.select(
        *keys, "turn_no", F.col("_turn.role").alias("role"),
        F.posexplode("_turn.content").alias("part_no", "_part"),
    ).select(*keys, "turn_no", "role", "part_no", "_part.type", "_part.text", "_part.image")
