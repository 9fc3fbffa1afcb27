"""Explicit schemas of every file the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


CATALOGUE = T.StructType(
    [T.StructField("id", T.IntegerType())]
    + _strings("subject", "city", "flore", "wiki", "other")
)

ANSWERS = T.StructType(
    _strings("id", "path", "dataset", "city", "subject", "answer_1", "answer_2")
)

# --- Fixed values: column names in the graded files, in file order, and ours --
GRADED_HEADER = {
    "ID": "id",
    "Algoritmo": "model",
    "Percorso": "path",
    "Dataset": "dataset",
    "Città": "city",
    "Soggetto_originale": "subject",
    "Risposta 1": "answer_1",
    "Valutazione 1 risposta": "score_1",
    "Città_1": "city_1",
    "Soggetto_1": "subject_1",
    "Descrizione_1": "description_1",
    "Risposta 2": "answer_2",
    "Valutazione 2 risposta": "score_2",
    "Soggetto_2": "subject_2",
    "Descrizione_2": "description_2",
    "Note": "note",
}
GRADED = T.StructType(
    [T.StructField("id", T.IntegerType())] + _strings(*list(GRADED_HEADER.values())[1:])
)

AUDITED = ("city_1", "subject_1", "description_1", "subject_2", "description_2")

PART = T.StructType(_strings("type", "text", "image"))
TURN = T.StructType(
    _strings("role") + [T.StructField("content", T.ArrayType(PART))]
)
DIALOGUE = T.ArrayType(TURN)
