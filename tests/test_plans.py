"""Plan guards for scale: no query may pair every row of a group with every other (cartesian
products, nested-loop joins), and scans must read only the columns a query needs."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from ledgerline.registry import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
QS = {name: build for name, build in E.queries().items() if name in QUERIES}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _nested_loops_over_data(plan: str) -> list[str]:
    """Nested-loop joins whose broadcast side is not a constant relation written in the query
    (a join against a one-row literal, left after constant folding, is only a filter)."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "BroadcastNestedLoopJoin" in line:
            window = lines[i + 1:i + 12]
            literal = any("BroadcastExchange IdentityBroadcastMode" in a and "LocalTableScan" in b
                          for a, b in zip(window, window[1:]))
            if not literal:
                bad.append(line.strip())
    return bad


@pytest.mark.parametrize("name", sorted(QS))
def test_no_pair_explosion(spark, name):
    plan = _plan(QS[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert _nested_loops_over_data(plan) == []


def test_web_rollup_reads_only_url_and_id(spark):
    plan = _plan(QS["web_request_rollup"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
    assert "html" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_flagship_prunes_lineitem_columns(spark):
    plan = _plan(E.entry(spark))
    for line in plan.splitlines():
        if "lineitem.parquet" in line and "ReadSchema" in line:
            schema = line.split("ReadSchema: ")[1]
            assert "l_tax" not in schema and "l_discount" not in schema


# Scans left in the executed plan, reused stages counted once: of the line items, and of all tables and shared views. (The
# fixture derives employee records from two scans, agreements from two and paystubs from three.)
MAX_SCANS = {"customer_status": (1, 23), "past_due_change_summary": (0, 19), "risk_burndown": (1, 19), "order_history": (2, 23),
             "schedule_anomalies": (0, 15), "ledger_risk": (0, 15), "pay_frequency_infer": (1, 14), "past_due_reconcile": (0, 11),
             "schedule_compare_detail": (1, 10), "schedule_start_compare": (0, 12), "product_hierarchy": (0, 17)}


def _final(df) -> list[str]:
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0].splitlines()


def _executed_scans(df, table: str = "") -> int:
    return sum("FileScan" in line and (not table or f"{table}.parquet" in line) for line in _final(df))


@pytest.mark.parametrize("name", sorted(MAX_SCANS))
def test_scans(spark, name):
    lines = _final(QS[name](spark, SF))
    scans = [line for line in lines if "FileScan" in line]
    lineitem = sum("lineitem.parquet" in line for line in scans)
    assert (lineitem <= MAX_SCANS[name][0], len(scans) <= MAX_SCANS[name][1]) == (True, True), (lineitem, len(scans))


def test_reports_read_shared_views_by_agreement_without_a_shuffle(spark):
    """The ledger and the model schedule are summed per agreement straight from their buckets."""
    from ledgerline.plans.pastdue import schedule_audit_vs_ledger
    from ledgerline.plans.common import ledger_view
    from ledgerline.plans.schedule import _schedule
    from ledgerline.sources import load_tables

    t = load_tables(spark, SF)
    model = _schedule(spark, t).groupBy("agreement_id").agg({"amount": "sum"})
    booked = ledger_view(spark, t).groupBy("agreement_id").agg({"amount": "max"})
    both = model.hint("merge").join(booked.hint("merge"), "agreement_id")
    assert not any("Exchange" in line for line in _final(both))
    assert schedule_audit_vs_ledger(_schedule(spark, t), ledger_view(spark, t), QUERIES and t["orders"].selectExpr(
        "o_orderkey AS id", "'open' AS status")).count() > 0


def test_score_documents_are_scanned_once(spark):
    assert _executed_scans(QS["scoring_detail"](spark, SF), "events") == 1
