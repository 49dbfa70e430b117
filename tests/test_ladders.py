"""Label ladders, employer filters and fan-outs that the driver tables reach only in part, on hand-made rows."""

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.plans.common import d  # noqa: E402
from ledgerline.plans.employers import _ces, sub_employer_summary  # noqa: E402
from ledgerline.plans.orders import _R09_DOMAIN, returns_summary  # noqa: E402
from ledgerline.plans.pastdue import past_due_change_summary  # noqa: E402
from ledgerline.plans.schedule import generate_schedule, past_due_reconcile  # noqa: E402
from ledgerline.sources import load_tables  # noqa: E402

SF = "/root/testdata/sf0.001"
DAY = dt.date(2001, 1, 10)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return load_tables(spark, SF)


def test_reconciliation_reaches_every_label(spark):
    """agreements / model / ledger past due of five customers, payments 0."""
    due = {1: (5, 5, 5), 2: (1, 5, 5), 3: (5, 1, 5), 4: (1, 2, 3), 5: (0, 0, 0), 6: (0, 4, 0), 7: (4, 0, 0)}
    rows = [(c, "current_transactions", Decimal(a), Decimal(m), Decimal(l), Decimal(0)) for c, (a, m, l) in due.items()]
    detail = spark.createDataFrame(rows, "customer_id long, transaction_timeframe string, total_customer_past_due decimal(18,2), "
                                         "scheduled_amt_model decimal(18,2), scheduled_amt_ledger decimal(18,2), paid_amount decimal(18,2)")
    manifest = spark.createDataFrame([(1, "A", "active"), (2, "B", "active")], "customer_id long, company_code string, employment_status string")
    department = spark.createDataFrame([("B", "disconnected")], "department_prefix string, status string")
    out = {r.customer_id: r for r in past_due_reconcile(detail, manifest, department).collect()}
    assert [out[c].analysis_status for c in (1, 2, 3, 4, 5)] == [
        "Clean - all models agree", "Model aligns with Ledgers", "Ledgers Align with Agreements", "Keep Investigating",
        "Clean - all models agree"]
    assert [out[c].evaluate_for_past_due for c in (1, 6, 7, 5)] == [
        "has_past_due_ledgers", "has_past_due_per_model", "has_past_due_per_agreements", "not_past_due"]
    assert (out[1].employee_status, out[2].employee_status, out[3].employee_status) == ("active", "disconnected", None)


def test_change_summary_counts_each_employee_record(spark, tables):
    """One payment before today, one instalment up to the last payment, one after it; two employee records, one and none."""
    txn = [(a, date, amount, src, kind) for a in (1, 2, 3) for date, amount, src, kind in (
        (DAY, Decimal("-10"), "payments", "paid_payroll_deduction"), (dt.date(2001, 8, 1), Decimal("-5"), "payments", "paid_payroll_deduction"),
        (dt.date(2001, 7, 31), Decimal("7"), "schedule_model", "schedule_model"), (dt.date(2001, 8, 2), Decimal("9"), "schedule_model", "schedule_model"),
        (DAY, Decimal("-99"), "payments", "initial_payment"))]
    transactions = spark.createDataFrame(txn, "agreement_id long, transaction_date date, amount decimal(18,2), analysis_source string, "
                                              "transaction_type string")
    manifest = spark.createDataFrame([(1,), (1,), (2,), (None,)], "customer_id long")
    agreements = d(spark, tables, "agreements").limit(0).unionByName(
        spark.range(1, 4).select("id", F.col("id").alias("customer_id"), F.lit(1).alias("employer_id")), allowMissingColumns=True)
    out = past_due_change_summary(transactions, manifest, d(spark, tables, "ledger"), agreements, d(spark, tables, "employer"),
                                  d(spark, tables, "agreement_deduction_variances"), d(spark, tables, "ledger_exceptions"))
    got = {r.agreement_id: (int(r.paid_per_model), int(r.scheduled_per_model), int(r.past_due_amount_per_model)) for r in out.collect()}
    assert got == {1: (-30, 14, -16), 2: (-15, 7, -8), 3: (-15, 7, -8)}


def test_schedule_of_one_employer(spark, tables):
    agreements, manifest = d(spark, tables, "agreements"), d(spark, tables, "employee_manifest")
    stubs, terms = d(spark, tables, "employee_paystubs"), d(spark, tables, "pay_frequency_terms")
    own = generate_schedule(agreements.where("employer_id = 7"), manifest, stubs, terms)
    found = _rows(generate_schedule(agreements, manifest, stubs, terms, employer_id=7))
    assert found and found == _rows(own)


def test_sub_employers_of_one_employer(spark, tables):
    manifest, detail = d(spark, tables, "employee_manifest"), d(spark, tables, "employer_subemployer_detail")
    found = sub_employer_summary(manifest, _ces(spark, tables), detail, employer_id=7)
    own = sub_employer_summary(manifest.where("employer_id = 7"), _ces(spark, tables).where("employer_id = 7"), detail)
    assert found.count() and _rows(found) == _rows(own)


def test_returns_keep_rows_of_other_employers(spark, tables):
    """The employer condition belongs to the department join: other rows stay, without a disconnect status."""
    inputs = [d(spark, tables, n) for n in _R09_DOMAIN]
    every, one = returns_summary(*inputs), returns_summary(*inputs, employer_id=7)
    assert every.count() == one.count()
    assert 0 < one.where("disconnect_status IS NOT NULL").count() < every.where("disconnect_status IS NOT NULL").count()
