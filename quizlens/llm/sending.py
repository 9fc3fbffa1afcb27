"""Objects of this package for tasks, which need not have the package installed."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def sent(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of any object of this package; read it with ``received``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> object:
    return pickle.loads(shared.value)
