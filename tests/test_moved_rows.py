"""Rows that are many times as many as their keys (ledger rows, instalments, order items) are moved by a shuffle as seldom as possible."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402,F401
from ledgerline.registry import QUERIES  # noqa: E402
from ledgerline.sources import Tables  # noqa: E402
from ledgerline.sources.shared import bucket_count  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def large(spark):
    """Only tables of a few rows are broadcast, as on large data."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "4k")
    yield spark
    spark.conf.set(key, old)


def _shuffled(spark, name: str) -> list[set[str]]:
    """The columns that each shuffle of the planned query moves."""
    found, todo = [], [QUERIES[name].build(spark, Tables(spark, SF))._jdf.queryExecution().executedPlan().initialPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            output = node.output()
            found.append({output.apply(i).name() for i in range(output.size())})
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert found
    return found


def test_burndown_writes_no_view_that_it_does_not_read(spark):
    t = Tables(spark, SF)
    QUERIES["risk_burndown"].build(spark, t)
    assert [k for k in t if k.startswith("%")] == []


def test_change_summary_sums_instalments_where_they_lie(large):
    assert not [c for c in _shuffled(large, "past_due_change_summary") if "transaction_date" in c]


def test_ledger_rows_of_the_flagship_are_not_moved(large):
    assert not [c for c in _shuffled(large, "ledger_risk") if "comment" in c]


@pytest.mark.parametrize("name", ["schedule_compare_detail", "past_due_reconcile"])
def test_transactions_are_not_moved(large, name):
    assert not [c for c in _shuffled(large, name) if c & {"analysis_source", "effective_date", "schedule_date"}]


def test_an_agreement_moves_without_its_buyer_s_columns(large):
    assert not [c for c in _shuffled(large, "order_history") if {"magento_order_number", "firstname"} <= c]


def test_items_are_moved_by_order_item_id_and_date_alone(large):
    """By date only where the calendar is too large to be broadcast."""
    assert len([c for c in _shuffled(large, "returns_summary") if "sku" in c]) <= 3


def test_the_schedule_view_holds_a_row_per_agreement_and_record(spark):
    from ledgerline.plans.schedule import _schedule

    t = Tables(spark, SF)
    assert _schedule(spark, t).count() > 5 * t["%schedule"].count()


def test_buckets_follow_the_sources(spark, monkeypatch):
    from ledgerline.sources import shared

    rows = spark.range(1000)
    assert bucket_count(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(shared, "BUCKET_BYTES", 500)
    assert bucket_count(rows, rows) == 32


@pytest.fixture()
def grown(spark, monkeypatch):
    """The tables count as if they had grown to many buckets; the session's settings are put back."""
    from ledgerline.sources import shared

    monkeypatch.setattr(shared, "BUCKET_BYTES", 8000)
    keys = [shared.INITIAL, shared.ADVISORY, shared._OURS]
    old = {k: spark.conf.get(k, None) for k in keys}
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _partition_counts(df) -> list[int]:
    """Partitions of each shuffle of the planned query."""
    found, todo = [], [df._jdf.queryExecution().executedPlan().initialPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append(node.outputPartitioning().numPartitions())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("name", ["past_due_reconcile", "generate_schedule"])
def test_no_shuffle_keeps_its_number_of_partitions_when_the_tables_grow(grown, name):
    t = Tables(grown, SF)
    few = int(grown.conf.get("spark.sql.shuffle.partitions"))
    counts = _partition_counts(QUERIES[name].build(grown, t))
    large = bucket_count(t["lineitem"], t["orders"])
    assert counts and min(c for c in counts if c > 1) >= large > 2 * few


def test_the_operator_s_numbers_are_left_alone(grown):
    from ledgerline.sources import shared

    grown.conf.set(shared.INITIAL, "7")
    grown.conf.set(shared.ADVISORY, "3m")
    QUERIES["generate_schedule"].build(grown, Tables(grown, SF))
    assert (grown.conf.get(shared.INITIAL), grown.conf.get(shared.ADVISORY)) == ("7", "3m")


def test_the_number_of_partitions_is_only_raised(grown):
    from ledgerline.sources import follow_sources, shared

    grown.conf.unset(shared.ADVISORY)
    follow_sources(grown.range(50_000))
    assert grown.conf.get(shared.INITIAL) == "50" and grown.conf.get(shared.ADVISORY) == "8000"
    follow_sources(grown.range(100_000))
    follow_sources(grown.range(10_000))
    assert grown.conf.get(shared.INITIAL) == "100"


def test_a_source_of_unknown_size_counts_nothing(spark):
    rows = spark.createDataFrame([(1,)], "k long")
    assert bucket_count(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_detail_makes_the_plan_where_it_reads_the_agreements(spark):
    from ledgerline.plans.schedule import _detail, _schedule

    t, other = Tables(spark, SF), Tables(spark, SF)
    direct = _detail(spark, t)
    assert "%schedule" not in t
    _schedule(spark, other)
    assert "%schedule" in other
    through_view = _detail(spark, other)
    assert direct.columns == through_view.columns
    assert sorted(map(str, direct.collect())) == sorted(map(str, through_view.collect()))
