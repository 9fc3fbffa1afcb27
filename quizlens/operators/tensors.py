"""Numeric models over batches of tensors.

Spark keeps the model per worker process and cuts the rows into batches, so a
call never gets more than ``batch_size`` rows, however large the input is.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from math import prod

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

BATCH_SIZE = 256
#: Gets one array per input, the first dimension being the row, and returns one value
#: or one vector per row.
Model = Callable[..., np.ndarray]


def add_prediction(data: DataFrame, column: str, inputs: Mapping[str, Sequence[int]],
                   make_model: Callable[[], Model], kind: T.DataType,
                   batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add the model's prediction for every row.

    ``inputs`` names the columns in the order of the model's arguments, with the
    shape of each row's tensor; a number is ``()``. Tensors come flat, as arrays.
    ``make_model`` runs once per worker process.

    A row with an input that is null, or that holds a null, gets a null and
    a tensor of zeros travels in its place. A tensor with another number of elements
    than its shape is an error, as is a prediction with another number of rows.
    """
    predict = predict_batch_udf(
        make_model, return_type=kind, batch_size=batch_size,
        input_tensor_shapes=[list(shape) for shape in inputs.values()])
    given = [_given(name, shape) for name, shape in inputs.items()]
    whole = reduce(lambda a, b: a & b, given)
    sent = [F.when(whole, _checked(name, shape)).otherwise(_zeros(shape))
            for name, shape in inputs.items()]
    return data.withColumn(column, F.when(whole, predict(*sent)))


def feature_tensor(*columns: str) -> Column:
    """Numeric columns as one tensor of that many elements, null if one of them is."""
    values = [F.col(c).cast("double") for c in columns]
    return F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]), F.array(*values))


def _given(name: str, shape: Sequence[int]) -> Column:
    value = F.col(name)
    if not shape:
        return value.isNotNull()
    return value.isNotNull() & ~F.exists(value, lambda x: x.isNull())


def _checked(name: str, shape: Sequence[int]) -> Column:
    if not shape:
        return F.col(name).cast("double")
    value, size = F.col(name).cast("array<double>"), prod(shape)
    wrong = F.concat(F.lit(f"{name}: expected {size} elements, not "), F.size(value).cast("string"))
    return F.when(F.size(value) == size, value).otherwise(
        F.raise_error(wrong).cast("array<double>"))


def _zeros(shape: Sequence[int]) -> Column:
    return F.array_repeat(F.lit(0.0), prod(shape)) if shape else F.lit(0.0)
