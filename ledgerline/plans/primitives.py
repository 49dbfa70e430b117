"""Operator-level queries on the driver tables.

Each one exercises one operator of the reports (latest row per key, as-of lookup, gaps, modal
value, cent split, label ladders, ...) on the raw tables, with a DuckDB statement computing the
same thing. Reports use the same operators on the domain tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (any_if, band, flag_list, label, local_date, max_if, min_if,
                         prefix_before, shift_weekend, split_cents, text_list, whole_units)
from ..operators import (asc_key, asof_prev_next, gaps, latest_per_key, latest_per_key_packed, literal_table,
                         list_rows, mode_per_key, semi_flag, sequence_per_key,
                         text_list_per_key)
from ..registry import register

AS_OF_TS = "2001-09-01 00:00:00"
AS_OF_DATE = "2001-09-01"


@register("latest_per_key", """
WITH r AS (
  SELECT user_id, event_id, ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events)
SELECT c_custkey, c_name, r.event_id AS last_event_id, r.ts AS last_ts,
       r.event_type AS last_event_type, r.value AS last_value
FROM customer LEFT JOIN r ON r.user_id = c_custkey AND r.rn = 1
""")
def latest_events(spark, t):
    last = latest_per_key(t["events"], ["user_id"], [F.col("ts"), F.col("event_id")],
                          ["event_id", "ts", "event_type", "value"])
    c = t["customer"].select("c_custkey", "c_name")
    return (c.join(last, c.c_custkey == last.user_id, "left")
             .select("c_custkey", "c_name", F.col("event_id").alias("last_event_id"),
                     F.col("ts").alias("last_ts"), F.col("event_type").alias("last_event_type"),
                     F.col("value").alias("last_value")))


@register("latest_per_key_packed", """
WITH r AS (
  SELECT user_id, event_type, event_id, ts, value, props,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) AS rn
  FROM events)
SELECT user_id, event_type, event_id, ts, value, props FROM r WHERE rn = 1
""")
def latest_events_by_type(spark, t):
    return latest_per_key_packed(t["events"], ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], "event_id",
                                 ["event_id", "ts", "value", "props"])


@register("priority_per_key_packed", """
WITH r AS (
  SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY
           CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 4 END,
           o_orderdate DESC NULLS LAST, o_orderkey) AS rn
  FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM r WHERE rn = 1
""")
def priority_orders_packed(spark, t):
    o = t["orders"]
    rank = label([(F.col("o_orderstatus") == "P", 1), (F.col("o_orderstatus") == "O", 2),
                  (F.col("o_orderstatus") == "F", 3)], 4)
    return latest_per_key_packed(o, ["o_custkey"],
                                 [(asc_key(rank), 1), F.col("o_orderdate"), (asc_key(F.col("o_orderkey")), 17)], "o_orderkey",
                                 ["o_orderkey", "o_totalprice", "o_orderdate"])


@register("priority_per_key", """
WITH r AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY
           CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 4 END,
           o_orderdate DESC, o_orderkey) AS rn
  FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM r WHERE rn = 1
""")
def priority_orders(spark, t):
    o = t["orders"]
    rank = label([(F.col("o_orderstatus") == "P", 1), (F.col("o_orderstatus") == "O", 2),
                  (F.col("o_orderstatus") == "F", 3)], 4)
    return latest_per_key(o, ["o_custkey"],
                          [asc_key(rank), F.col("o_orderdate"), asc_key(F.col("o_orderkey"))],
                          ["o_orderkey", "o_orderstatus", "o_orderdate"])


@register("order_sequence", """
SELECT o_orderkey, o_custkey,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS cust_order_sequence
FROM orders
""")
def order_sequence(spark, t):
    o = t["orders"].select("o_orderkey", "o_custkey")
    return (sequence_per_key(o, ["o_custkey"], [F.col("o_orderkey")], "cust_order_sequence")
            .withColumn("cust_order_sequence", F.col("cust_order_sequence").cast("bigint")))


def _customer_ship_dates(t):
    """Distinct (customer, ship date) pairs: bounded per customer by the days in the data."""
    li = t["lineitem"].select("l_orderkey", "l_shipdate")
    o = t["orders"].select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .select("o_custkey", F.to_date("l_shipdate").alias("ship_date")).distinct())


@register("schedule_gaps", """
WITH d AS (SELECT DISTINCT o_custkey, CAST(l_shipdate AS DATE) AS ship_date
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT o_custkey, ship_date, lag(ship_date) OVER (PARTITION BY o_custkey ORDER BY ship_date) AS prior_date
      FROM d)
SELECT o_custkey, ship_date, prior_date, CAST(datediff('day', prior_date, ship_date) AS BIGINT) AS gap_days,
       CASE WHEN datediff('day', prior_date, ship_date) <= 3 THEN 'duplicate' ELSE 'missing' END AS gap_kind
FROM g
WHERE datediff('day', prior_date, ship_date) <= 3 OR datediff('day', prior_date, ship_date) > 45
""")
def schedule_gaps(spark, t):
    g = gaps(_customer_ship_dates(t), ["o_custkey"], "ship_date")
    return (g.where((F.col("gap_days") <= 3) | (F.col("gap_days") > 45))
             .select("o_custkey", "ship_date", "prior_date", F.col("gap_days").cast("bigint").alias("gap_days"),
                     F.when(F.col("gap_days") <= 3, "duplicate").otherwise("missing").alias("gap_kind")))


@register("modal_gap", """
WITH d AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem),
g AS (SELECT l_suppkey, datediff('day', lag(ship_date) OVER (PARTITION BY l_suppkey ORDER BY ship_date), ship_date) AS gap
      FROM d),
c AS (SELECT l_suppkey, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY l_suppkey, gap),
r AS (SELECT l_suppkey, gap, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, gap) AS rn FROM c)
SELECT l_suppkey, CAST(gap AS BIGINT) AS modal_gap, CAST(n AS BIGINT) AS modal_count FROM r WHERE rn = 1
""")
def modal_gap(spark, t):
    d = t["lineitem"].select("l_suppkey", F.to_date("l_shipdate").alias("ship_date")).distinct()
    g = gaps(d, ["l_suppkey"], "ship_date")
    m = mode_per_key(g, ["l_suppkey"], "gap_days", "modal_gap", "modal_count")
    return m.select("l_suppkey", F.col("modal_gap").cast("bigint"), F.col("modal_count").cast("bigint"))


@register("asof_prev_next", """
WITH s AS (SELECT DISTINCT o_custkey AS ck, l_shipdate AS sd FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate,
       (SELECT max(sd) FROM s WHERE s.ck = o.o_custkey AND s.sd <= o.o_orderdate) AS prev_ship_date,
       (SELECT min(sd) FROM s WHERE s.ck = o.o_custkey AND s.sd > o.o_orderdate) AS next_ship_date
FROM orders o
""")
def asof_ship(spark, t):
    li = t["lineitem"].select("l_orderkey", "l_shipdate")
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    ships = li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey) \
              .select("o_custkey", "l_shipdate")
    return asof_prev_next(o, ships, ["o_custkey"], "o_orderdate", "l_shipdate",
                          "prev_ship_date", "next_ship_date")


@register("cent_split", """
WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
                  CAST(1 + o_orderkey % 26 AS INT) AS n_parts FROM orders)
SELECT o_orderkey, n_parts, total,
       CAST(floor(total * 100 / n_parts) / 100 AS DECIMAL(18,2)) AS base_amount,
       CAST(floor(total * 100 / n_parts) / 100
            + (round(total * 100, 0) - floor(total * 100 / n_parts) * n_parts) / 100 AS DECIMAL(18,2)) AS last_amount
FROM o
""")
def cent_split(spark, t):
    o = t["orders"].select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
                           (1 + F.col("o_orderkey") % 26).cast("int").alias("n_parts"))
    base, rem = split_cents(F.col("total"), F.col("n_parts"))
    return o.select("o_orderkey", "n_parts", "total", base.alias("base_amount"),
                    (base + rem).cast("decimal(18,2)").alias("last_amount"))


@register("distinct_lists", """
SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS n_event_types,
       string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types,
       CAST(sum(DISTINCT CASE WHEN event_type = 'purchase' THEN 1 END) AS INT) AS any_purchase
FROM events GROUP BY user_id
""")
def distinct_lists(spark, t):
    e = t["events"]
    return e.groupBy("user_id").agg(
        F.count_distinct("event_type").cast("bigint").alias("n_event_types"),
        text_list(F.col("event_type"), ",").alias("event_types"),
        any_if(F.col("event_type") == "purchase").alias("any_purchase"))


@register("string_agg_ordered", """
SELECT o_custkey, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ';'
                             ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS order_dates
FROM orders GROUP BY o_custkey
""")
def string_agg_ordered(spark, t):
    o = t["orders"]
    return o.groupBy("o_custkey").agg(
        text_list(F.date_format("o_orderdate", "yyyy-MM-dd"), ";").alias("order_dates"))


@register("text_list_large", """
SELECT l_returnflag, string_agg(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), ',' ORDER BY l_shipdate) AS ship_dates,
       string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ';' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers
FROM lineitem GROUP BY l_returnflag
""")
def text_list_large(spark, t):
    li = t["lineitem"].select("l_returnflag", F.to_date("l_shipdate").alias("ship_date"), "l_suppkey")
    dates = text_list_per_key(li, ["l_returnflag"], "ship_date", "ship_dates", distinct=False)
    return dates.join(text_list_per_key(li, ["l_returnflag"], "l_suppkey", "suppliers", sep=";"), "l_returnflag")


@register("text_list_rows", """
SELECT l_returnflag, l_linestatus, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS BIGINT) AS position,
       CAST(l_extendedprice AS DOUBLE) AS l_extendedprice
FROM lineitem
""")
def text_list_rows(spark, t):
    rows = list_rows(t["lineitem"], ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return rows.withColumns({"position": F.col("position").cast("bigint"), "l_extendedprice": F.col("l_extendedprice").cast("double")})


@register("flag_list", """
SELECT o_orderkey,
       nullif(concat_ws(', ',
         CASE WHEN o_totalprice > 300000 THEN 'high_value' END,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END,
         CASE WHEN o_orderstatus = 'O' THEN 'open' END), '') AS flags
FROM orders
""")
def flags(spark, t):
    o = t["orders"]
    one = lambda c: F.when(c, 1).otherwise(0)
    return o.select("o_orderkey", flag_list({
        "high_value": one(F.col("o_totalprice") > 300000),
        "urgent": one(F.col("o_orderpriority") == "1-URGENT"),
        "open": one(F.col("o_orderstatus") == "O")}).alias("flags"))


@register("json_fields", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       json_extract_string(props, '$.missing') AS missing,
       json_extract(props, '$.k') IS NOT NULL AS has_k
FROM events
""")
def json_fields(spark, t):
    from ..functions import json_present, json_str
    e = t["events"]
    return e.select("event_id", json_str(F.col("props"), "$.k").try_cast("bigint").alias("k"),
                    json_str(F.col("props"), "$.missing").alias("missing"),
                    json_present(F.col("props"), "$.k").alias("has_k"))


@register("month_hour_diff", f"""
SELECT o_orderkey,
       CAST(datesub('month', o_orderdate, TIMESTAMP '{AS_OF_TS}') AS BIGINT) AS months_elapsed,
       CAST(datesub('hour', o_orderdate, TIMESTAMP '{AS_OF_TS}') AS BIGINT) AS hours_elapsed
FROM orders
""")
def month_hour_diff(spark, t):
    o = t["orders"]
    as_of = F.lit(AS_OF_TS).cast("timestamp_ntz")
    return o.select("o_orderkey",
                    whole_units("MONTH", F.col("o_orderdate"), as_of).cast("bigint").alias("months_elapsed"),
                    whole_units("HOUR", F.col("o_orderdate"), as_of).cast("bigint").alias("hours_elapsed"))


@register("weekend_shift", """
SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS order_weekday,
       CAST(CASE isodow(o_orderdate) WHEN 6 THEN CAST(o_orderdate AS DATE) + 2
                                     WHEN 7 THEN CAST(o_orderdate AS DATE) + 1
                                     ELSE CAST(o_orderdate AS DATE) END AS DATE) AS shifted_date
FROM orders
""")
def weekend_shift(spark, t):
    o = t["orders"]
    d = F.to_date("o_orderdate")
    return o.select("o_orderkey", F.weekday(d).alias("order_weekday"), shift_weekend(d).alias("shifted_date"))


@register("agreement_window", f"""
WITH b AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS created,
         CASE o_orderkey % 4 WHEN 0 THEN 14 WHEN 1 THEN 31 WHEN 2 THEN 15 ELSE 7 END + 5 + CAST(o_custkey % 10 AS INT) AS span_days,
         CAST(3 * (1 + o_orderkey % 4) AS INT) AS term FROM orders),
w AS (SELECT o_orderkey, created, created + span_days AS latest_start,
             CAST((created + span_days) + to_months(term) AS DATE) AS latest_end FROM b)
SELECT o_orderkey, latest_start, latest_end,
       CASE WHEN latest_end <= created THEN NULL
            WHEN DATE '{AS_OF_DATE}' >= latest_end THEN 1.0
            WHEN DATE '{AS_OF_DATE}' <= created THEN 0.0
            ELSE datediff('day', created, DATE '{AS_OF_DATE}') / datediff('day', created, latest_end) END
         AS pct_elapsed
FROM w
""")
def agreement_window(spark, t):
    o = t["orders"]
    created = F.to_date("o_orderdate")
    cycle = label([(F.col("o_orderkey") % 4 == 0, 14), (F.col("o_orderkey") % 4 == 1, 31),
                   (F.col("o_orderkey") % 4 == 2, 15)], 7)
    span = cycle + 5 + (F.col("o_custkey") % 10).cast("int")
    term = (3 * (1 + F.col("o_orderkey") % 4)).cast("int")
    as_of = F.lit(AS_OF_DATE).cast("date")
    w = o.select("o_orderkey", created.alias("created"),
                 F.date_add(created, span).alias("latest_start"),
                 F.add_months(F.date_add(created, span), term).alias("latest_end"))
    pct = label([(F.col("latest_end") <= F.col("created"), F.lit(None).cast("double")),
                 (as_of >= F.col("latest_end"), F.lit(1.0)),
                 (as_of <= F.col("created"), F.lit(0.0))],
                F.try_divide(F.datediff(as_of, F.col("created")),
                             F.datediff(F.col("latest_end"), F.col("created"))))
    return w.select("o_orderkey", "latest_start", "latest_end", pct.alias("pct_elapsed"))


@register("tz_date", """
SELECT event_id, CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS local_date
FROM events
""")
def tz_date(spark, t):
    e = t["events"]
    return e.select("event_id", local_date(F.col("ts"), "America/Chicago").alias("local_date"))


@register("tenure_bands", """
WITH b AS (SELECT c_custkey, CAST(c_custkey % 16 - 1 AS INT) AS tenure_months,
                  CAST(450 + c_custkey % 200 AS INT) AS score FROM customer)
SELECT c_custkey, tenure_months,
       CASE WHEN tenure_months BETWEEN 0 AND 6 THEN '0-6'
            WHEN tenure_months BETWEEN 7 AND 9 THEN '7-9'
            WHEN tenure_months BETWEEN 10 AND 12 THEN '10-12' ELSE '12+' END AS tenure_band,
       score,
       CASE WHEN score <= 500 THEN '0-500' WHEN score <= 550 THEN '501-550'
            WHEN score <= 575 THEN '551-575' WHEN score <= 600 THEN '576-600'
            WHEN score > 600 THEN '600+' END AS score_band
FROM b
""")
def tenure_bands(spark, t):
    c = t["customer"].select("c_custkey", (F.col("c_custkey") % 16 - 1).cast("int").alias("tenure_months"),
                             (450 + F.col("c_custkey") % 200).cast("int").alias("score"))
    s = F.col("score")
    return c.select("c_custkey", "tenure_months",
                    band(F.col("tenure_months"), [(0, 6, "0-6"), (7, 9, "7-9"), (10, 12, "10-12")], "12+")
                    .alias("tenure_band"),
                    "score",
                    label([(s <= 500, "0-500"), (s <= 550, "501-550"), (s <= 575, "551-575"),
                           (s <= 600, "576-600"), (s > 600, "600+")]).alias("score_band"))


@register("reason_category", """
SELECT p_partkey,
       CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%hot%' THEN 'hot'
            WHEN p_name LIKE '%plate%' THEN 'plate' WHEN p_name LIKE '%widget%' THEN 'widget'
            WHEN p_name LIKE '%large%' THEN 'large' ELSE 'other' END AS reason_category
FROM part
""")
def reason_category(spark, t):
    p = t["part"]
    n = F.col("p_name")
    return p.select("p_partkey", label([(n.contains("ring"), "ring"), (n.contains("hot"), "hot"),
                                        (n.contains("plate"), "plate"), (n.contains("widget"), "widget"),
                                        (n.contains("large"), "large")], "other").alias("reason_category"))


@register("risk_driver", f"""
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'P' THEN 'pending order'
            WHEN datediff('day', o_orderdate, TIMESTAMP '{AS_OF_TS}') > 2000 THEN 'stale order'
            WHEN o_totalprice > 400000 THEN 'large order'
            WHEN o_orderpriority LIKE '1%' THEN 'urgent order'
            WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'open and large'
            ELSE 'low risk' END AS risk_driver
FROM orders
""")
def risk_driver(spark, t):
    o = t["orders"]
    age = F.datediff(F.lit(AS_OF_DATE).cast("date"), F.to_date("o_orderdate"))
    return o.select("o_orderkey", label([
        (F.col("o_orderstatus") == "P", "pending order"),
        (age > 2000, "stale order"),
        (F.col("o_totalprice") > 400000, "large order"),
        (F.col("o_orderpriority").startswith("1"), "urgent order"),
        ((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000), "open and large"),
    ], "low risk").alias("risk_driver"))


@register("cutoff_reason", """
WITH s AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END) AS first_return,
                  max(CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) END) AS last_accept
           FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS promise_date,
             s.first_return, s.last_accept
      FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey),
c AS (SELECT *, least(coalesce(promise_date, DATE '9999-12-31'), coalesce(first_return, DATE '9999-12-31'),
                      coalesce(last_accept, DATE '9999-12-31')) AS m FROM b)
SELECT o_orderkey, CASE WHEN m = DATE '9999-12-31' THEN NULL ELSE m END AS earliest_cutoff,
       CASE WHEN m = DATE '9999-12-31' THEN 'NONE'
            WHEN m = promise_date THEN 'promise_date'
            WHEN m = first_return THEN 'first_return'
            ELSE 'last_accept' END AS cutoff_reason
FROM c
""")
def cutoff_reason(spark, t):
    from ..functions.dates import first_of
    li = t["lineitem"]
    s = li.groupBy("l_orderkey").agg(
        min_if(F.col("l_returnflag") == "R", F.to_date("l_shipdate")).alias("first_return"),
        max_if(F.col("l_returnflag") == "A", F.to_date("l_shipdate")).alias("last_accept"))
    o = t["orders"].select("o_orderkey", F.date_add(F.to_date("o_orderdate"),
                                                    (F.col("o_orderkey") % 40).cast("int")).alias("promise_date"))
    b = o.join(s, o.o_orderkey == s.l_orderkey, "left")
    value, reason = first_of({"promise_date": F.col("promise_date"), "first_return": F.col("first_return"),
                              "last_accept": F.col("last_accept")})
    return b.select("o_orderkey", value.alias("earliest_cutoff"), reason.alias("cutoff_reason"))


@register("agreement_milestones", """
SELECT l_orderkey,
       min(CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END) AS first_return_date,
       max(CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) END) AS last_accepted_date,
       CAST(min(CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END) IS NULL AS INT) AS no_return
FROM lineitem GROUP BY l_orderkey
""")
def agreement_milestones(spark, t):
    li = t["lineitem"]
    g = li.groupBy("l_orderkey").agg(
        min_if(F.col("l_returnflag") == "R", F.to_date("l_shipdate")).alias("first_return_date"),
        max_if(F.col("l_returnflag") == "A", F.to_date("l_shipdate")).alias("last_accepted_date"))
    return g.withColumn("no_return", F.col("first_return_date").isNull().cast("int"))


def _orders_with_returns(t):
    li = t["lineitem"].where(F.col("l_returnflag") == "R") \
                      .groupBy("l_orderkey").agg(F.sum("l_quantity").alias("r_qty"))
    o = t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").drop("l_orderkey")


_RETURNS_SQL = """WITH r AS (SELECT l_orderkey, sum(l_quantity) AS r_qty FROM lineitem WHERE l_returnflag = 'R'
                   GROUP BY l_orderkey),
b AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, r.r_qty
      FROM orders LEFT JOIN r ON r.l_orderkey = o_orderkey)
"""


@register("or_filter", _RETURNS_SQL + """
SELECT o_orderkey, o_orderstatus, r_qty FROM b
WHERE o_orderstatus = 'P' OR (o_totalprice > 300000 AND o_orderpriority = '1-URGENT') OR r_qty > 150
""")
def or_filter(spark, t):
    b = _orders_with_returns(t)
    return b.where((F.col("o_orderstatus") == "P")
                   | ((F.col("o_totalprice") > 300000) & (F.col("o_orderpriority") == "1-URGENT"))
                   | (F.col("r_qty") > 150)).select("o_orderkey", "o_orderstatus", "r_qty")


@register("in_list", _RETURNS_SQL + """
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM b
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')
""")
def in_list(spark, t):
    b = _orders_with_returns(t)
    return b.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F")) \
            .select("o_orderkey", "o_orderpriority", "o_orderstatus")


@register("null_compare", _RETURNS_SQL + """
SELECT o_orderkey, r_qty, r_qty IS NULL AS no_returns FROM b
WHERE r_qty <> 25 OR r_qty IS NULL
""")
def null_compare(spark, t):
    b = _orders_with_returns(t)
    return b.where((F.col("r_qty") != 25) | F.col("r_qty").isNull()) \
            .select("o_orderkey", "r_qty", F.col("r_qty").isNull().alias("no_returns"))


@register("multi_key_join", """
WITH ps AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS ps_total_qty, count(*) AS ps_lines
            FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, ps.ps_total_qty,
       CAST(ps.ps_lines AS BIGINT) AS ps_lines
FROM lineitem l LEFT JOIN ps ON ps.l_partkey = l.l_partkey AND ps.l_suppkey = l.l_suppkey
""")
def multi_key_join(spark, t):
    li = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    ps = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("ps_total_qty"),
                                                  F.count("*").alias("ps_lines"))
    return li.join(ps, ["l_partkey", "l_suppkey"], "left") \
             .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "ps_total_qty", "ps_lines")


@register("agg_then_join", """
WITH o AS (SELECT o_custkey, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total_spent
           FROM orders GROUP BY o_custkey)
SELECT c_custkey, CAST(coalesce(o.n_orders, 0) AS BIGINT) AS n_orders, o.total_spent
FROM customer LEFT JOIN o ON o.o_custkey = c_custkey
""")
def agg_then_join(spark, t):
    o = t["orders"].groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total_spent"))
    c = t["customer"].select("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left") \
            .select("c_custkey", F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"), "total_spent")


@register("left_pred_on", """
SELECT o_orderkey, o_orderpriority, c_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
""")
def left_pred_on(spark, t):
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority")
    c = t["customer"].select("c_custkey", "c_name")
    return o.join(c, (o.o_custkey == c.c_custkey) & (o.o_orderpriority == "1-URGENT"), "left") \
            .select("o_orderkey", "o_orderpriority", "c_name")


@register("expr_key_join", """
WITH cal AS (SELECT CAST(d AS DATE) AS calendar_date, CAST(date_trunc('week', d) AS DATE) AS week_start_date
             FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d
                   FROM events))
SELECT event_id, CAST(ts AS DATE) AS event_date, cal.week_start_date
FROM events LEFT JOIN cal ON cal.calendar_date = CAST(ts AS DATE)
""")
def expr_key_join(spark, t):
    e = t["events"].select("event_id", F.to_date("ts").alias("event_date"))
    span = e.agg(F.min("event_date").alias("lo"), F.max("event_date").alias("hi"))
    cal = span.select(F.explode(F.sequence("lo", "hi")).alias("calendar_date")) \
              .withColumn("week_start_date", F.to_date(F.date_trunc("week", "calendar_date")))
    return e.join(cal, e.event_date == cal.calendar_date, "left").select("event_id", "event_date", "week_start_date")


@register("eav_lookup", """
WITH v AS (
  SELECT p_partkey AS entity_id, 'name' AS attribute_code, p_name AS value FROM part
  UNION ALL SELECT p_partkey, 'brand', p_brand FROM part
  UNION ALL SELECT p_partkey, 'type', p_type FROM part)
SELECT p.p_partkey, n.value AS name, b.value AS brand
FROM part p
LEFT JOIN v n ON n.entity_id = p.p_partkey AND n.attribute_code = 'name'
LEFT JOIN v b ON b.entity_id = p.p_partkey AND b.attribute_code = 'brand'
""")
def eav_lookup(spark, t):
    p = t["part"]
    v = p.select(F.col("p_partkey").alias("entity_id"), "p_name", "p_brand", "p_type") \
         .unpivot("entity_id", ["p_name", "p_brand", "p_type"], "attr", "value") \
         .withColumn("attribute_code", F.regexp_replace("attr", "^p_", "")).drop("attr")
    wide = v.groupBy("entity_id").pivot("attribute_code", ["name", "brand"]).agg(F.first("value"))
    return p.select("p_partkey").join(wide, F.col("p_partkey") == F.col("entity_id"), "left") \
            .select("p_partkey", "name", "brand")


@register("semi_flag", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, l_returnflag
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT DISTINCT o_custkey FROM l WHERE l_returnflag = 'R')
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.o_custkey,
       CASE WHEN f.o_custkey IS NOT NULL THEN 1 END AS customer_has_return
FROM l LEFT JOIN f ON f.o_custkey = l.o_custkey
""")
def semi(spark, t):
    li = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    o = t["orders"].select("o_orderkey", "o_custkey")
    lines = li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")
    return semi_flag(lines, ["o_custkey"], F.col("l_returnflag") == "R", "customer_has_return") \
        .select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "customer_has_return")


@register("cycle_constants", """
WITH k AS (SELECT * FROM (VALUES (0, 'Bi-Weekly', 14), (1, 'Monthly', 31), (2, 'Semi-Monthly', 15),
                                 (3, 'Weekly', 7)) AS t(idx, cycle_type, cycle_max_days))
SELECT o_orderkey, k.cycle_type, k.cycle_max_days FROM orders JOIN k ON k.idx = o_orderkey % 4
""")
def cycle_constants(spark, t):
    # fixed values: cycle type -> longest cycle in days
    k = literal_table(spark, [(0, "Bi-Weekly", 14), (1, "Monthly", 31), (2, "Semi-Monthly", 15), (3, "Weekly", 7)],
                      "idx long, cycle_type string, cycle_max_days int")
    o = t["orders"].select("o_orderkey", (F.col("o_orderkey") % 4).alias("idx"))
    return o.join(k, "idx").select("o_orderkey", "cycle_type", "cycle_max_days")


@register("union_distinct", """
SELECT o_custkey AS customer_id FROM orders WHERE o_orderstatus = 'P'
UNION
SELECT c_custkey FROM customer WHERE c_acctbal < 0
""")
def union_distinct(spark, t):
    a = t["orders"].where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("customer_id"))
    b = t["customer"].where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("customer_id"))
    return a.union(b).distinct()


@register("prefix_before", """
SELECT s_suppkey,
       CASE WHEN strpos(s_name, '#') > 0 THEN substring(s_name, 1, strpos(s_name, '#') - 1) ELSE '' END AS name_prefix,
       CASE WHEN strpos(s_name, '@') > 0 THEN substring(s_name, 1, strpos(s_name, '@') - 1) ELSE '' END AS absent_prefix
FROM supplier
""")
def prefix(spark, t):
    s = t["supplier"]
    return s.select("s_suppkey", prefix_before(F.col("s_name"), "#").alias("name_prefix"),
                    prefix_before(F.col("s_name"), "@").alias("absent_prefix"))
