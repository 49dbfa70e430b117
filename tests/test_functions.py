"""Hand-made cases for the column helpers and operators (edge cases the driver data lacks)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import (band, flag_list, json_present, json_str, label, path_part, prefix_before,
                                  shift_weekend, split_cents, step_date, text_list, trim_leading, whole_units)
from ledgerline.functions.dates import first_of, wall_micros
from ledgerline.functions.money import exact_div
from ledgerline.operators import asof_prev_next, expand_periods, gaps, latest_per_key, mode_per_key, semi_flag, sequence_per_key
from ledgerline.plans.common import norm


def D(s):
    return dt.date.fromisoformat(s)


def test_split_cents_sums_to_total(spark):
    df = spark.createDataFrame([(Decimal("100.00"), 3), (Decimal("0.05"), 4), (Decimal("1234.57"), 52)],
                               "total decimal(18,2), n int")
    base, rem = split_cents(F.col("total"), F.col("n"))
    rows = df.select("total", "n", base.alias("b"), rem.alias("r")).collect()
    for r in rows:
        assert r.b * (r.n - 1) + (r.b + r.r) == r.total
    assert rows[0].b == Decimal("33.33") and rows[0].r == Decimal("0.01")
    assert rows[1].b == Decimal("0.01") and rows[1].r == Decimal("0.01")


def test_step_date_month_end_and_half_month(spark):
    df = spark.createDataFrame([(D("2021-01-31"), n) for n in range(5)], "anchor date, n int")
    out = {r.n: (r.m, r.s, r.w) for r in df.select(
        "n", step_date(F.col("anchor"), F.col("n"), F.lit("Monthly")).alias("m"),
        step_date(F.col("anchor"), F.col("n"), F.lit("Semi-Monthly")).alias("s"),
        step_date(F.col("anchor"), F.col("n"), F.lit("Weekly")).alias("w")).collect()}
    assert out[0] == (D("2021-01-31"), D("2021-01-31"), D("2021-01-31"))
    assert out[1][0] == D("2021-02-28")            # month end clamps
    assert out[1][1] == D("2021-02-15")            # odd step: anchor + 0 months + 15 days
    assert out[2][1] == D("2021-02-28")            # even step: anchor + 1 month (clamped)
    assert out[3][1] == D("2021-03-15")            # computed from the anchor, not the previous row
    assert out[4][2] == D("2021-02-28")


def test_expand_periods_bounds(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 104), (4, 105)], "id int, n int")
    counts = {r.id: r.c for r in expand_periods(df, "n").groupBy("id").agg(F.count("*").alias("c")).collect()}
    assert counts == {2: 1, 3: 104, 4: 105}
    with pytest.raises(Exception, match="more than 104 periods: 105"):
        expand_periods(df, "n", 104).collect()


def _rows(df):
    return sorted(map(str, df.collect()))


def test_balanced_operators_keep_null_keys_and_null_order(spark):
    rows = [(1, "2021-01-01"), (1, "2021-03-09"), (1, None), (None, "2021-02-02"), (None, "2021-02-12"), (None, None), (2, None)]
    df = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "k int, i int, t string").withColumn("t", F.col("t").cast("date"))
    got = gaps(df, ["k"], "t", order=["i"])
    assert got.count() == len(rows) and _rows(got) == _rows(gaps(df, ["k"], "t", order=["i"], balanced=False))
    order = [F.col("t"), F.col("i")]
    assert _rows(sequence_per_key(df, ["k"], order)) == _rows(sequence_per_key(df, ["k"], order, balanced=False))
    right = spark.createDataFrame([(1, "2021-01-05"), (None, "2021-02-05"), (2, None), (2, "2021-05-05")], "k int, r string") \
        .withColumn("r", F.col("r").cast("date"))
    both = [asof_prev_next(df, right, ["k"], "t", "r", balanced=b) for b in (True, False)]
    assert _rows(both[0]) == _rows(both[1]) and both[0].count() == len(rows)
    found = {r.i: (str(r.prev), str(r.next)) for r in both[0].collect()}
    assert found == {0: ("None", "2021-01-05"), 1: ("2021-01-05", "None"), **{i: ("None", "None") for i in (2, 3, 4, 5, 6)}}


def test_long_term_sums_to_its_total(spark):
    df = spark.createDataFrame([(1, 130, Decimal("1000.01"))], "id int, n int, total decimal(18,2)")
    base, rest = split_cents(F.col("total"), F.col("n"))
    x = expand_periods(df.select("*", base.alias("b"), rest.alias("r")), "n", name="k")
    amount = F.col("b") + F.when(F.col("k") + 1 == F.col("n"), F.col("r")).otherwise(F.lit(0))
    assert x.agg(F.count("*"), F.sum(amount)).first()[:] == (130, Decimal("1000.01"))


def test_clock_change_does_not_reorder_wall_clock_values(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        times = ["2021-03-14 01:59:59.5", "2021-03-14 02:30:00", "2021-03-14 03:10:00", "2021-11-07 01:30:00.000001"]
        df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
        got = [r.m for r in df.select(wall_micros(F.col("t")).alias("m"), "t").orderBy("t").collect()]
        assert got == sorted(got) and got[1] - got[0] == 1_800_500_000 + 0 and got[3] % 1_000_000 == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_band_edges(spark):
    df = spark.createDataFrame([(0.095,), (0.105,), (0.1051,), (None,)], "x double")
    got = [r.b for r in df.select(band(F.col("x"), [(0.095, 0.105, "10_pct")]).alias("b")).collect()]
    assert got == ["10_pct", "10_pct", None, None]


def test_label_first_match_wins(spark):
    df = spark.createDataFrame([(5,), (15,), (40,)], "d int")
    c = F.col("d")
    got = [r.l for r in df.select(label([(c > 30, "31+"), (c > 10, "11-30"), (c > 0, "1-10")], "none").alias("l"))
           .collect()]
    assert got == ["1-10", "11-30", "31+"]


def test_flag_list_null_when_no_flag(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "a int, b int")
    got = [r.f for r in df.select(flag_list({"a": F.col("a"), "b": F.col("b")}).alias("f")).collect()]
    assert got == [None, "a", "a, b"]


def test_weekend_shift_to_monday(spark):
    df = spark.createDataFrame([(D("2024-01-06"),), (D("2024-01-07"),), (D("2024-01-08"),), (None,)], "d date")
    got = [r.s for r in df.select(shift_weekend(F.col("d")).alias("s")).collect()]
    assert got == [D("2024-01-08"), D("2024-01-08"), D("2024-01-08"), None]


def test_whole_months_database_style(spark):
    df = spark.createDataFrame([(D("1994-01-31"), D("2001-06-30")), (D("2020-01-31"), D("2020-02-29")),
                                (D("2020-03-15"), D("2020-01-20"))], "a date, b date")
    got = [r.m for r in df.select(whole_units("MONTH", F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [88, 0, -1]


def test_json_null_missing_and_broken(spark):
    df = spark.createDataFrame([('{"score": null}',), ('{"other": 1}',), ("not json{",), ('{"score": 7}',)], "j string")
    rows = df.select(json_present(F.col("j"), "$.score").alias("p"), json_str(F.col("j"), "$.score").alias("s")).collect()
    assert [r.p for r in rows] == [True, False, False, True]
    assert [r.s for r in rows] == [None, None, None, "7"]


def test_path_pieces(spark):
    paths = ["/", "/12", "/shop", "/shop/product/12/slug", "//a/b/", "/shop/"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    t = trim_leading(F.col("path"), "/")
    rows = df.select("path", F.substring_index(t, "/", 1).alias("section"), path_part(t, 3).alias("third"),
                     F.substring_index("path", "/", -1).alias("last")).collect()
    got = {r.path: (r.section, r.third, r.last) for r in rows}
    assert got["/12"] == ("12", "12", "12")           # fewer than 3 parts: the last part
    assert got["/shop/product/12/slug"] == ("shop", "12", "slug")
    assert got["//a/b/"] == ("a", "", "")
    assert got["/"] == ("", "", "")


def test_prefix_before(spark):
    df = spark.createDataFrame([("Bi-Weekly:Friday",), ("Monthly",), (None,)], "s string")
    got = [r.p for r in df.select(prefix_before(F.col("s"), ":").alias("p")).collect()]
    assert got == ["Bi-Weekly", "", ""]


def test_first_of_sentinel_and_reason(spark):
    df = spark.createDataFrame([(None, None, None), (D("2020-01-02"), D("2020-01-02"), None),
                                (D("2020-01-05"), None, D("2020-01-03"))], "a date, b date, c date")
    v, r = first_of({"a": F.col("a"), "b": F.col("b"), "c": F.col("c")})
    rows = df.select(v.alias("v"), r.alias("r")).collect()
    assert [(x.v, x.r) for x in rows] == [(None, "NONE"), (D("2020-01-02"), "a"), (D("2020-01-03"), "c")]


def test_exact_div_half_up_and_sign(spark):
    df = spark.createDataFrame([(Decimal("1.00"), Decimal("8.00")), (Decimal("-1.00"), Decimal("8.00")),
                                (Decimal("2.00"), Decimal("3.00")), (Decimal("1.00"), Decimal("0.00"))],
                               "n decimal(18,2), d decimal(18,2)")
    got = [r.q for r in df.select(exact_div(F.col("n"), F.col("d"), 2).alias("q")).collect()]
    assert got == [Decimal("0.13"), Decimal("-0.13"), Decimal("0.67"), None]


def test_text_list_nulls_and_order(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, "a"), (2, None)], "k int, v string")
    got = {r.k: r.l for r in df.groupBy("k").agg(text_list(F.col("v"), ",").alias("l")).collect()}
    assert got == {1: "a,b", 2: None}


def test_norm_case_and_trailing_space(spark):
    df = spark.createDataFrame([("Terminated",), ("terminated ",), ("TERMINATED",), ("active",)], "s string")
    assert [r.t for r in df.select((norm("s") == "terminated").alias("t")).collect()] == [True, True, True, False]


def test_asof_boundaries(spark):
    left = spark.createDataFrame([(1, 10, D("2020-01-10")), (2, 10, D("2020-01-01")), (3, 10, D("2020-02-01")),
                                  (4, 20, D("2020-01-10"))], "id int, k int, t date")
    right = spark.createDataFrame([(10, D("2020-01-05")), (10, D("2020-01-10")), (10, D("2020-01-20"))], "k int, t2 date")
    out = {r.id: (r.prev, r.next) for r in asof_prev_next(left, right, ["k"], "t", "t2").collect()}
    assert out[1] == (D("2020-01-10"), D("2020-01-20"))   # equal date counts as "at or before"
    assert out[2] == (None, D("2020-01-05"))
    assert out[3] == (D("2020-01-20"), None)
    assert out[4] == (None, None)


def test_latest_per_key_tie_break(spark):
    df = spark.createDataFrame([(1, D("2020-01-01"), 5, "x"), (1, D("2020-01-01"), 7, "y"), (2, D("2019-01-01"), 1, "z")],
                               "k int, t date, id int, v string")
    out = {r.k: r.v for r in latest_per_key(df, ["k"], [F.col("t"), F.col("id")], ["v"]).collect()}
    assert out == {1: "y", 2: "z"}


def test_mode_ties_to_smaller(spark):
    df = spark.createDataFrame([(1, 14), (1, 7), (1, 14), (1, 7), (2, 30)], "k int, g int")
    out = {r.k: r.modal_g for r in mode_per_key(df, ["k"], "g").collect()}
    assert out == {1: 7, 2: 30}


def test_gaps_and_semi_flag(spark):
    df = spark.createDataFrame([(1, D("2020-01-01"), "a"), (1, D("2020-01-03"), "b"), (2, D("2020-01-01"), "a")],
                               "k int, d date, s string")
    g = {(r.k, r.d): r.gap_days for r in gaps(df, ["k"], "d").collect()}
    assert g == {(1, D("2020-01-01")): None, (1, D("2020-01-03")): 2, (2, D("2020-01-01")): None}
    f = {(r.k, r.s): r.has_b for r in semi_flag(df, ["k"], F.col("s") == "b", "has_b").collect()}
    assert f == {(1, "a"): 1, (1, "b"): 1, (2, "a"): None}
