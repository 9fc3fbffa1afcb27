"""Answer cleaning by named steps, so that each model's recipe is data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from quizlens.functions import text as T

# Each step takes the text and the columns it may need, by name.
STEPS = {
    "cut_marker": lambda text, cols: T.cut_at_marker(text),
    "collapse": lambda text, cols: T.collapse_ws(text),
    "newlines": lambda text, cols: T.delete_newlines(text),
    "echo_1": lambda text, cols: T.remove_echo(text, cols["question_1"]),
    "echo_2": lambda text, cols: T.remove_echo(text, cols["question_2"]),
    "echo_1_wrapped": lambda text, cols: T.remove_wrapped_echo(text, cols["question_1"]),
    "prefix": lambda text, cols: T.drop_prefix(text, F.coalesce(
        cols["rendered_length"],
        F.raise_error("the responder gave no length of the request").cast("int"))),
}


def clean(text: Column, steps: Iterable[str], cols: Mapping[str, Column]) -> Column:
    """Apply the steps in order."""
    for step in steps:
        text = STEPS[step](text, cols)
    return text


def clean_by_model(text: Column, model: Column, recipes: Mapping[str, tuple[str, ...]],
                   cols: Mapping[str, Column]) -> Column:
    """Apply each model's own recipe to its rows.

    Models with the same recipe share one branch. A model without a recipe is
    an error rather than an uncleaned answer.
    """
    models_of: dict[tuple[str, ...], list[str]] = {}
    for name, steps in recipes.items():
        models_of.setdefault(tuple(steps), []).append(name)
    result = None
    for steps, names in models_of.items():
        condition, value = model.isin(names), clean(text, steps, cols)
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(
        F.raise_error(F.concat(F.lit("no cleaning recipe for model: "),
                               F.coalesce(model, F.lit("null")))).cast("string")
    )
