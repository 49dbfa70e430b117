"""Shared views (sources.shared): written once, bucketed by key, plain Parquet where one key holds too much."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import Tables, forget, shared_view, write_bucketed
from ledgerline.sources import shared as S


def _rows(df):
    return sorted(map(str, df.collect()))


def _shuffles(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ")


@pytest.fixture()
def even(spark):
    return spark.range(2000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"), F.lit(None).cast("string").alias("n"))


def test_rows_and_reads_without_a_shuffle(spark, even):
    view = write_bucketed(even, "k", 4)
    assert _rows(view) == _rows(even)
    total = view.groupBy("k").agg(F.sum("v").alias("s"))
    assert _shuffles(total) == 0 and _rows(total) == _rows(even.groupBy("k").agg(F.sum("v").alias("s")))


def test_null_keys_and_empty_views(spark, even):
    some = even.withColumn("k", F.when(F.col("k") > 100, F.col("k")))
    assert _rows(write_bucketed(some, "k", 3)) == _rows(some)
    assert write_bucketed(even.limit(0), "k", 3).count() == 0


def test_a_hot_key_gives_plain_files(spark):
    hot = spark.range(4000).select(F.when(F.col("id") % 3 != 0, 7).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    view = write_bucketed(hot, "k", 16, uneven_bytes=1000)
    assert _rows(view) == _rows(hot)
    assert _shuffles(view.groupBy("k").count()) == 1        # no bucket is taken for a partition
    assert _shuffles(write_bucketed(hot, "k", 16).groupBy("k").count()) == 0


def test_built_once_until_forgotten(spark, even, tmp_path):
    t, built = Tables(spark, str(tmp_path)), []
    view = lambda: shared_view(t, "v", "k", lambda: built.append(1) or even)
    assert view() is view() and len(built) == 1
    forget(t)
    view()
    assert len(built) == 2


def test_the_folder_is_the_session_s(spark):
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == S.shared_dir(spark)
    assert any(f.startswith("ledgerline_") for f in os.listdir(S.shared_dir(spark).removeprefix("file:")))
