"""Ordered lists of very large keys (operators.lists)."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text_list
from ledgerline.operators import list_rows, text_list_per_key


@pytest.fixture(scope="module")
def rows(spark):
    """A key with most rows and many repeats, a NULL key, small keys, NULL values, a key without a value."""
    n = F.col("id")
    k = F.when(n % 2 == 0, 1).when(n % 5 == 1, None).otherwise(n % 40)
    return spark.range(4000).select(k.alias("k"), F.when(n % 11 != 0, F.concat(F.lit("v"), (n * 7919) % 700)).alias("v")).unionByName(
        spark.createDataFrame([(99, None)], "k long, v string")).cache()


@pytest.mark.parametrize("limit", [5, 100, 100_000])
@pytest.mark.parametrize("distinct", [True, False])
def test_equal_to_the_plain_list(rows, limit, distinct):
    want = rows.groupBy("k").agg(text_list(F.col("v"), ", ", distinct=distinct).alias("l")).where("l IS NOT NULL")
    got = text_list_per_key(rows, ["k"], "v", "l", ", ", distinct, limit)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_form(rows):
    got = list_rows(rows, ["k"], "v", range_rows=30).orderBy("k", "position").collect()
    for key in {r.k for r in got}:
        mine = [r for r in got if r.k == key]
        assert [r.position for r in mine] == list(range(1, len(mine) + 1)) and [r.v for r in mine] == sorted(r.v for r in mine)
    assert len(got) == rows.where("v IS NOT NULL").count()


def test_a_million_values_of_one_key(spark):
    many = spark.range(1_000_000).select(F.lit(1).alias("k"), F.format_string("%07d", F.col("id")).alias("v"))
    got = text_list_per_key(many, ["k"], "v", "l", range_rows=50_000)
    assert got.select(F.length("l")).first()[0] == 8 * 1_000_000 - 1
    assert got.select(F.substring("l", 1, 15)).first()[0] == "0000000,0000001"
    assert list_rows(many, ["k"], "v", range_rows=50_000).where("position <> cast(v as int) + 1").count() == 0
