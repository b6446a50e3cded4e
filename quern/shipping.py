"""Broadcasting Python objects of this package to workers that need not have it installed."""

from __future__ import annotations

from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def ship(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of the value with its classes; read it with ``unpack``. The caller vouches for its size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpack(shipped: Broadcast) -> Any:
    return cloudpickle.loads(shipped.value)
