"""Best row per key by a packed sort value (operators.packed)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import latest_per_key, latest_per_key_packed, packed_order

SCHEMA = "k string, day date, ts timestamp_ntz, rank int, id long, small short, ok boolean, x double, note string, list array<int>"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    none = lambda v: None if rng.random() < 0.15 else v
    data = [(none(rng.choice("abcd")), none(dt.date(rng.choice([1, 1969, 2024, 9999]), 1, rng.randrange(1, 5))),
             none(dt.datetime(rng.choice([1, 1969, 2024, 9999]), 12, 31, 23, 59, 59, rng.randrange(3))), none(rng.randrange(-3, 3)),
             rng.choice([-1, 1]) * (2 ** 62 + i), none(rng.randrange(-9, 9)), none(rng.random() < 0.5), none(rng.random()), none(f"n{i}"),
             none([i])) for i in range(600)] + [("e", None, None, None, -2 ** 63, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(7)


@pytest.mark.parametrize("order", [["ts", "id"], ["day", "id"], ["rank", "small", "ok", "id"], ["ok", "day", "id"], ["id"]])
def test_same_row_as_the_struct_order(rows, order):
    cols = [F.col(c) for c in order]
    for payload in (["x", "ts", "id"], ["note", "x", "list", "day"], ["id"], None):
        want = sorted(map(str, latest_per_key(rows, ["k"], cols, payload).collect()))
        assert sorted(map(str, latest_per_key_packed(rows, ["k"], cols, "id", payload).collect())) == want


def test_number_sorts_like_the_tuple(rows):
    got = rows.select("day", "rank", "small", packed_order(rows, [F.col("day"), F.col("rank")]).alias("p"),
                      packed_order(rows, [(F.col("rank"), 1), (F.col("small"), 2), F.col("ts")]).alias("q"), "ts")
    assert [f.dataType.simpleString() for f in got.schema if f.name in "pq"] == ["bigint", "decimal(38,0)"]
    key = lambda *v: tuple((x is not None, x if x is not None else 0) for x in v)
    for number, of in (("p", lambda r: key(r.day, r.rank)), ("q", lambda r: key(r.rank, r.small, r.ts) if r.ts else key(r.rank, r.small) + ((False,),))):
        some = got.collect()
        assert sorted({r[number] for r in some}) == [n for n, _ in sorted({(r[number], of(r)) for r in some}, key=lambda x: x[1])]


def test_what_does_not_fit_is_an_error(spark, rows):
    with pytest.raises(ValueError, match="do not fit"):
        packed_order(rows, [F.col("ts"), F.col("id"), F.col("rank")])
    with pytest.raises(TypeError, match="string"):
        packed_order(rows, [F.col("note")])
    with pytest.raises(Exception, match="more than 1 digits"):
        spark.createDataFrame([(1, 10)], "k int, v int").transform(lambda d: latest_per_key_packed(d, ["k"], [(F.col("v"), 1)], "k")).collect()


def test_aggregate_hashes(rows):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    order = [F.col("ts"), F.col("id")]
    assert "SortAggregate" in plan(latest_per_key(rows, ["k"], order, ["x"]))
    for payload in (["x", "id"], ["note"]):
        text = plan(latest_per_key_packed(rows, ["k"], order, "id", payload))
        assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_empty_and_clashing_names(rows):
    df = rows.withColumnsRenamed({"note": "_p0", "x": "_order", "list": "_row"})
    want = sorted(map(str, latest_per_key(df, ["k"], [F.col("id")]).collect()))
    assert sorted(map(str, latest_per_key_packed(df, ["k"], [F.col("id")], "id").collect())) == want
    assert latest_per_key_packed(df.limit(0), ["k"], [F.col("id")], "id").count() == 0
