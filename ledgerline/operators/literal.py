"""Small constant relations written in the code (status attributes, cycle constants)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A constant relation, marked for broadcast: its size is fixed by the code, not the data."""
    return F.broadcast(spark.createDataFrame(list(rows), schema=schema))
