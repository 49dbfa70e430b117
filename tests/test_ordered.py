"""Scans in ranges (operators.ordered): equal to the plain windows, and heavy keys are spread over tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import asof_prev_next, gaps, sequence_per_key
from ledgerline.operators import ordered as R


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def rows(spark):
    """A key with a third of all rows inside one month, a NULL key as heavy, a key on one day, small keys, NULL dates, ties."""
    rng = random.Random(5)
    out = [(1, rng.randrange(28)) for _ in range(600)] + [(None, rng.randrange(900)) for _ in range(400)] + [(2, 7)] * 300
    out += [(k, rng.randrange(2000)) for k in range(3, 60) for _ in range(rng.randrange(1, 12))] + [(1, None)] * 5 + [(9, None)]
    out = [(k, i, d) for i, (k, d) in enumerate(out)]
    rng.shuffle(out)
    return (spark.createDataFrame(out, "k int, i int, n int").repartition(5)
            .select("k", "i", F.date_add(F.lit("2021-03-01").cast("date"), F.col("n")).alias("t")).cache())


def _order():
    return [F.col("t"), F.col("i")]


@pytest.mark.parametrize("limit", [3, 40, 250, 10_000])
def test_equal_to_plain_windows(spark, rows, limit):
    same = lambda f: _rows(f(balanced=True, range_rows=limit)) == _rows(f(balanced=False))
    assert same(lambda **o: sequence_per_key(rows, ["k"], _order(), **o))
    assert same(lambda **o: gaps(rows, ["k"], "t", order=["i"], **o))
    dates = rows.select("k", "t").distinct()
    assert same(lambda **o: gaps(dates, ["k"], "t", **o))
    right = rows.where("i % 3 = 0").select("k", F.date_add("t", (F.col("i") % 5).cast("int")).alias("r"))
    assert same(lambda **o: asof_prev_next(rows, right, ["k"], "t", "r", **o))


def test_heavy_keys_are_spread_and_ranges_are_even(rows):
    got = {}
    for r in R.in_ranges(rows, ["k"], _order(), 50).groupBy("k", "_range").count().collect():
        got.setdefault(r.k, {})[r["_range"]] = r["count"]
    assert {k for k, v in got.items() if None not in v} == {None, 1, 2}       # keys of at most 50 rows stay whole
    for key, n in ((1, 605), (None, 400), (2, 300)):
        assert len(got[key]) >= n // 50 - 1 and max(got[key].values()) <= 2 * 50
        assert sum(got[key].values()) == n


def test_ranges_follow_the_order_and_the_values_only(spark, rows):
    w = Window.partitionBy("k").orderBy(*_order())
    a = R.in_ranges(rows, ["k"], _order(), 20)
    steps = a.withColumn("step", F.col("_range") - F.lag("_range").over(w)).where("step < 0")
    assert steps.count() == 0
    assert _rows(a) == _rows(R.in_ranges(rows.repartition(11, "i"), ["k"], _order(), 20))   # another layout, the same ranges


def test_rows_of_equal_order_are_parted_by_ties(rows):
    one_day = rows.where("k = 2")
    count = lambda **o: R.in_ranges(one_day, ["k"], [F.col("t")], 50, **o).select("_range").distinct().count()
    assert count() == 1 and count(ties=[F.xxhash64("k", "i", "t")]) >= 5


def test_most_ranges_of_one_key(spark):
    many = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    got = R.in_ranges(many, ["k"], [F.col("i")], 1).groupBy("_range").count().collect()
    assert R.MAX_RANGES // 2 < len(got) <= R.MAX_RANGES and max(r["count"] for r in got) < 3 * 20_000 / R.MAX_RANGES


def test_without_heavy_keys_the_plan_is_the_plain_window(spark, rows):
    df = sequence_per_key(rows, ["k"], _order())
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Window") == 1 and "BroadcastHashJoin" not in final and "SortMergeJoin" not in final
