"""Invariants of the reports: exact cent splits, one row per stated grain, total
label ladders, left-join reports keep every base row."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from ledgerline.registry import domain  # noqa: E402
from ledgerline.sources import load_tables  # noqa: E402

SF = "/root/testdata/sf0.001"
QS = E.queries()


def q(spark, name):
    return QS[name](spark, SF)


def records(spark):
    """Employee records per customer: reports that join them repeat a row for each."""
    manifest = domain(spark, load_tables(spark, SF), "employee_manifest").where("customer_id IS NOT NULL")
    return manifest.groupBy("customer_id").agg(F.count("*").alias("n"))


def test_instalments_sum_to_total(spark):
    """Once for every employee record of the customer."""
    sched = q(spark, "generate_schedule").groupBy("agreement_id").agg(F.sum("amount").alias("s"))
    a = domain(spark, load_tables(spark, SF), "agreements").select(F.col("id").alias("agreement_id"), "customer_id", "total")
    both = sched.join(a, "agreement_id").join(records(spark), "customer_id")
    assert both.count() == sched.count()
    bad = both.where(F.col("s") != F.col("total") * F.col("n")).count()
    assert bad == 0


BY_RECORD = {"order_history", "customer_status", "past_due_reconcile", "schedule_anomalies", "pay_frequency_infer",
             "schedule_start_compare"}


@pytest.mark.parametrize("name,grain", [
    ("scoring_detail", ["entity_id"]), ("order_history", ["agreement_id"]), ("customer_status", ["id"]),
    ("product_hierarchy", ["sku"]), ("past_due_reconcile", ["customer_id"]),
    ("past_due_change_summary", ["agreement_id"]), ("schedule_anomalies", ["agreement_id"]),
    ("pay_frequency_infer", ["employee_manifest_id"]), ("schedule_start_compare", ["agreement_id"]),
    ("registration_funnel", ["email"]), ("conversion_funnel", ["customer_id"]),
    ("web_request_rollup", ["section", "sub_type", "item_id", "slug"]), ("pay_periods", ["id"]),
])
def test_one_row_per_grain(spark, name, grain):
    df = q(spark, name)
    dup = df.groupBy(*[F.col(c) for c in grain]).count().where(F.col("count") > 1)
    if name in BY_RECORD:   # repeated only for customers with several employee records
        t = load_tables(spark, SF)
        several = records(spark).where("n > 1").select("customer_id")
        keys = {"customer_id": several,
                "agreement_id": domain(spark, t, "agreements").join(several, "customer_id").select(F.col("id").alias("agreement_id"))}
        own = domain(spark, t, "employee_manifest").join(several, "customer_id")
        keys |= {k: own.select(F.col("id").alias(k)) for k in ("id", "employee_manifest_id")}
        dup = dup.join(keys[grain[0]], grain, "left_anti")
    assert dup.count() == 0


@pytest.mark.parametrize("name,col", [
    ("customer_status", "risk_driver"), ("cart_to_checkout", "checkout_status"),
    ("schedule_anomalies", "primary_error"), ("ledger_risk", "risk_bucket"),
    ("order_history", "past_due_amount_adjusted_reason"), ("past_due_reconcile", "analysis_status"),
    ("pay_frequency_infer", "pay_frequency_inferred"),
])
def test_label_ladders_are_total(spark, name, col):
    assert q(spark, name).where(F.col(col).isNull()).count() == 0


def test_left_join_reports_keep_base_rows(spark):
    t = load_tables(spark, SF)
    assert q(spark, "scoring_detail").count() == domain(spark, t, "customer_entity").count()
    orders = domain(spark, t, "agreements").join(records(spark), "customer_id", "left")
    assert q(spark, "order_history").count() == orders.agg(F.sum(F.coalesce("n", F.lit(1)))).first()[0]
    assert q(spark, "product_hierarchy").count() == domain(spark, t, "catalog_product_entity").count()
    logins = domain(spark, t, "sso_login_attempts").select("email").distinct().count()
    assert q(spark, "registration_funnel").count() == logins


def test_ordered_option_sorts(spark):
    from ledgerline.plans.scoring import scoring_detail
    t = load_tables(spark, SF)
    rows = scoring_detail(domain(spark, t, "customer_entity"), domain(spark, t, "customer_score"),
                          domain(spark, t, "employee_manifest"), ordered=True).select("start_date", "salary").collect()
    keys = [(r.start_date is not None, r.start_date, -(r.salary or 0)) for r in rows]
    assert keys == sorted(keys)
