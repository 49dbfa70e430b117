"""Lazy access to the Parquet tables of one data directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables(dict):
    """``name -> DataFrame``; a table is opened on first use only.

    Opening is lazy in Spark too: nothing is read until an action, and Catalyst prunes the
    columns and pushes filters into each Parquet scan.
    """

    def __init__(self, spark: SparkSession, root: str):
        super().__init__()
        self.spark = spark
        self.root = root

    def __missing__(self, name: str) -> DataFrame:
        path = os.path.join(self.root, f"{name}.parquet")
        df = self.spark.read.parquet(path)
        self[name] = df
        return df


_OPEN: dict[tuple[int, str], Tables] = {}


def load_tables(spark: SparkSession, root: str) -> Tables:
    """Table handles of ``root`` for this session, opened once and reused.

    Only the lazy DataFrames (and the domain tables derived from them) are kept, never data:
    every action still reads the files.
    """
    key = (id(spark), os.path.abspath(root))
    t = _OPEN.get(key)
    if t is None or t.spark is not spark:
        t = _OPEN[key] = Tables(spark, root)
    return t
