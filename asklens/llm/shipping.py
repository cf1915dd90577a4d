"""Broadcasts of this library's own objects to workers that have no copy of it."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shipped:
    """A broadcast object that carries the code of its class; ``value`` is loaded once per task."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._sent.value)
        return self._value

    def unpersist(self) -> None:
        self._sent.unpersist()
