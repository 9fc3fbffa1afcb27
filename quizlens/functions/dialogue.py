"""Dialogues as arrays of turns: ``role`` and a list of text or image parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quizlens import schemas


def _part(kind: str, text: Column | None = None, image: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("type"),
        (null if text is None else text).alias("text"),
        (null if image is None else image).alias("image"),
    )


def _turn(role: str, *parts: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content")))


def _only_if(condition: Column, turns: Column) -> Column:
    return F.when(condition, turns).otherwise(F.array().cast(schemas.DIALOGUE))


def user_turn(question: Column, image: Column | None = None, show_image: Column | None = None,
              image_first: Column | None = None) -> Column:
    """One user turn; the picture is left out where ``show_image`` is false and
    precedes the question where ``image_first`` is true."""
    text = _part("text", text=question)
    if image is None:
        return _turn("user", text)
    picture = _part("image", image=image)
    with_image = _turn("user", text, picture)
    if image_first is not None:
        with_image = F.when(image_first, _turn("user", picture, text)).otherwise(with_image)
    if show_image is None:
        return with_image
    return F.when(show_image, with_image).otherwise(_turn("user", text))


def assistant_turn(answer: Column) -> Column:
    return _turn("assistant", _part("text", text=answer))


def first_dialogue(question: Column, image: Column, blank_turn: Column,
                   image_first: Column) -> Column:
    """The first question with its picture, plus an empty answer where wanted."""
    blank = _only_if(blank_turn, assistant_turn(F.lit("")))
    return F.concat(user_turn(question, image, image_first=image_first), blank)


def second_dialogue(question_1: Column, answer_1: Column, question_2: Column, image: Column,
                    history: Column, image_in_turn_2: Column, blank_turn: Column,
                    image_first: Column) -> Column:
    """The second question, after the first exchange where ``history`` is true.

    With history the picture stays with the first question; without it, the
    second question carries the picture itself.
    """
    blank = _only_if(blank_turn, assistant_turn(F.lit("")))
    with_history = F.concat(
        user_turn(question_1, image, image_in_turn_2, image_first),
        blank,
        assistant_turn(answer_1),
        user_turn(question_2),
        blank,
    )
    alone = F.concat(user_turn(question_2, image, image_in_turn_2, image_first), blank)
    return F.when(history, with_history).otherwise(alone)
