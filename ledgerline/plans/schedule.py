"""Instalment schedules and past-due reconciliation.

R11 ``generate_schedule``: model schedule per agreement (anchor from the nearest paystubs,
equal cents with the remainder on the last instalment, weekly / bi-weekly / monthly /
semi-monthly steps).
R12 ``schedule_start_compare``: first ledger schedule date against the model's, and past due
per model. R13 ``schedule_compare_detail``: payments, model and ledger schedule on one
transaction list. R14 ``past_due_reconcile``: per customer, agreement vs model vs ledger.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import label, split_cents, step_date
from ..operators import asof_prev_next, expand_periods
from ..registry import register, with_domain
from ..sources.shared import has_view, shared_view
from .common import AS_OF, d, for_employer, ledger_view, lit_date, norm, view_buckets

# ---------------------------------------------------------------------------------------------
# R11


def agreements_with_paystubs(agreements: DataFrame, manifest: DataFrame, paystubs: DataFrame,
                             employer_id: int | None) -> DataFrame:
    """Agreements of the employer with their employee row, the first pay date after the
    agreement date and the latest pay date at or before it."""
    a = for_employer(agreements, employer_id).select(
        "customer_id", F.col("id").alias("agreement_id"), "magento_order_number",
        F.col("status").alias("agreement_status"), "term", "date_created",
        F.col("total").alias("total_amount"), F.col("past_due_amount").alias("agreement_past_due_amt"))
    em = manifest.where(F.col("customer_id").isNotNull()).select(
        "customer_id", F.col("id").alias("employee_manifest_id"), "pay_frequency")
    base = a.join(em, "customer_id")
    stubs = paystubs.select("employee_manifest_id", "pay_date")
    return asof_prev_next(base, stubs, ["employee_manifest_id"], "date_created", "pay_date",
                          prev_name="most_recent_pay_date", next_name="first_pay_date")


def generate_schedule(agreements: DataFrame, manifest: DataFrame, paystubs: DataFrame,
                      pay_frequency_terms: DataFrame, *, employer_id: int | None = None,
                      max_periods: int | None = None, with_paystubs: DataFrame | None = None) -> DataFrame:
    """``with_paystubs``: the result of :func:`agreements_with_paystubs` when the caller already
    has it (reports that need it twice compute the as-of lookup once)."""
    return instalments(schedule_plan(agreements, manifest, paystubs, pay_frequency_terms, employer_id=employer_id,
                                     with_paystubs=with_paystubs), max_periods=max_periods)


def schedule_plan(agreements: DataFrame, manifest: DataFrame, paystubs: DataFrame, pay_frequency_terms: DataFrame, *,
                  employer_id: int | None = None, with_paystubs: DataFrame | None = None) -> DataFrame:
    """What the instalments of an agreement follow from, one row for each of its employee records: anchor date, number of
    periods, amounts, diagnostics."""
    a = with_paystubs if with_paystubs is not None else \
        agreements_with_paystubs(agreements, manifest, paystubs, employer_id)
    pft = pay_frequency_terms.select("term", "pay_frequency", "num_periods",
                                                 "approx_pay_cycle_days")
    b = a.join(pft, ["term", "pay_frequency"])
    cycle = F.col("approx_pay_cycle_days")
    first, recent, created = F.col("first_pay_date"), F.col("most_recent_pay_date"), F.col("date_created")
    anchor = F.coalesce(first, F.date_add(recent, cycle), F.date_add(created, cycle))
    base_amt, rem_amt = split_cents(F.col("total_amount"), F.col("num_periods"))
    stale = F.datediff(created, recent)
    long_gap = F.datediff(first, created)
    diagnostics = F.concat_ws(
        "; ",
        label([(first.isNotNull(), "anchor=first_pay_date"),
               (recent.isNotNull(), "anchor=most_recent_pay_date+1cycle")],
              "anchor=date_created+1cycle (NO_ANCHOR_DATA)"),
        F.when(first.isNull() & recent.isNotNull() & (stale > 60),
               F.concat(F.lit("STALE_PAYSTUB("), stale.cast("string"), F.lit("d)"))),
        F.when(first.isNotNull() & (long_gap > 35),
               F.concat(F.lit("LONG_FIRST_PAY_GAP("), long_gap.cast("string"), F.lit("d)"))),
        F.when(first.isNotNull() & (first < created), F.lit("FIRST_PAY_BEFORE_CREATED")),
        F.when((F.col("pay_frequency") == "Semi-Monthly") & first.isNotNull() & (F.dayofmonth(first) > 16),
               F.concat(F.lit("SEMIMONTHLY_AMBIGUOUS_ANCHOR(day="), F.dayofmonth(first).cast("string"),
                        F.lit(")"))))
    return b.select("agreement_id", "pay_frequency", "term", "num_periods",
                    anchor.alias("anchor_date"), base_amt.alias("base_amount"),
                    rem_amt.alias("remainder_amount"), diagnostics.alias("diagnostics"))


def instalments(plan: DataFrame, *, max_periods: int | None = None) -> DataFrame:
    """The rows of :func:`schedule_plan`, one for each instalment."""
    x = expand_periods(plan, "num_periods", max_periods)
    n = F.col("n")
    amount = F.when(n + 1 == F.col("num_periods"), F.col("base_amount") + F.col("remainder_amount")) \
              .otherwise(F.col("base_amount")).cast("decimal(18,2)")
    return x.select("agreement_id", "pay_frequency", "term",
                    step_date(F.col("anchor_date"), n, F.col("pay_frequency")).alias("schedule_date"),
                    amount.alias("amount"), "diagnostics")


def _with_paystubs(spark, t):
    key = "@@agreements_with_paystubs"
    if key not in t:
        t[key] = agreements_with_paystubs(d(spark, t, "agreements"), d(spark, t, "employee_manifest"),
                                          d(spark, t, "employee_paystubs"), None)
    return t[key]


def _with_paystubs_view(spark, t):
    """The same rows as a view, for reports that need them beside the schedule: the schedule's plan is then made from the view too,
    and the as-of lookup runs once."""
    key = "@@agreements_with_paystubs"
    t[key] = shared_view(t, "agreements_with_paystubs", "agreement_id", lambda: _with_paystubs(spark, t), view_buckets(t))
    return t[key]


def _generated(spark, t):
    return generate_schedule(d(spark, t, "agreements"), d(spark, t, "employee_manifest"), d(spark, t, "employee_paystubs"),
                             d(spark, t, "pay_frequency_terms"), with_paystubs=_with_paystubs(spark, t))


def _plan(spark, t):
    return schedule_plan(d(spark, t, "agreements"), d(spark, t, "employee_manifest"), d(spark, t, "employee_paystubs"),
                         d(spark, t, "pay_frequency_terms"), with_paystubs=_with_paystubs(spark, t))


def _schedule(spark, t):
    """R11's result as R12 to R17 read it: the plan of each agreement is a view, computed once and bucketed by agreement; the
    instalments, many times its rows, are made from it where it is read, in the same tasks."""
    return instalments(shared_view(t, "schedule", "agreement_id", lambda: _plan(spark, t), view_buckets(t)))


_R11_SQL = """
near AS (
  SELECT ag.id AS agreement_id, ag.customer_id, em.id AS employee_manifest_id, em.pay_frequency, ag.term, ag.date_created,
         ag.total, nxt.pay_date AS first_pay_date, prv.pay_date AS most_recent_pay_date
  FROM agreements ag JOIN employee_manifest em USING (customer_id)
  ASOF LEFT JOIN employee_paystubs prv ON prv.employee_manifest_id = em.id AND ag.date_created >= prv.pay_date
  ASOF LEFT JOIN employee_paystubs nxt ON nxt.employee_manifest_id = em.id AND ag.date_created < nxt.pay_date),
planned AS (
  SELECT near.*, num_periods, CAST(total * 100 AS BIGINT) AS cents, approx_pay_cycle_days AS cycle,
         first_pay_date - date_created AS wait, date_created - most_recent_pay_date AS age
  FROM near JOIN pay_frequency_terms USING (term, pay_frequency)),
anchored AS (
  SELECT planned.*, coalesce(first_pay_date, coalesce(most_recent_pay_date, date_created) + cycle) AS anchor,
         unnest(range(num_periods)) AS n,
         array_to_string(list_filter([
           'anchor=' || CASE WHEN wait IS NOT NULL THEN 'first_pay_date'
                             WHEN age IS NOT NULL THEN 'most_recent_pay_date+1cycle'
                             ELSE 'date_created+1cycle (NO_ANCHOR_DATA)' END,
           if(wait IS NULL AND age > 60, 'STALE_PAYSTUB(' || age || 'd)', NULL),
           if(wait > 35, 'LONG_FIRST_PAY_GAP(' || wait || 'd)', NULL),
           if(wait < 0, 'FIRST_PAY_BEFORE_CREATED', NULL),
           if(pay_frequency = 'Semi-Monthly' AND day(first_pay_date) > 16,
              'SEMIMONTHLY_AMBIGUOUS_ANCHOR(day=' || day(first_pay_date) || ')', NULL)],
           lambda x: x IS NOT NULL), '; ') AS diagnostics
  FROM planned),
schedule AS (
  -- months and days to add to the anchor for the n-th instalment; the odd cents go on the last one
  SELECT agreement_id, pay_frequency, term, diagnostics,
         CAST(anchor + to_months(CAST(CASE pay_frequency WHEN 'Monthly' THEN n WHEN 'Semi-Monthly' THEN n // 2 ELSE 0 END AS INT))
                + to_days(CAST(CASE pay_frequency WHEN 'Weekly' THEN 7 * n WHEN 'Bi-Weekly' THEN 14 * n
                                    WHEN 'Semi-Monthly' THEN 15 * (n % 2) ELSE 0 END AS INT)) AS DATE) AS schedule_date,
         CAST((cents // num_periods + if(n = num_periods - 1, cents % num_periods, 0)) / 100 AS DECIMAL(18,2)) AS amount
  FROM anchored)
"""

_R11_DOMAIN = ["agreements", "employee_manifest", "employee_paystubs", "pay_frequency_terms"]


@register("generate_schedule", with_domain(_R11_DOMAIN, "WITH " + _R11_SQL + "SELECT * FROM schedule"))
def _q_generate_schedule(spark, t):
    return _generated(spark, t)


# ---------------------------------------------------------------------------------------------
# R12


def schedule_start_compare(ledger: DataFrame, agreements: DataFrame, manifest: DataFrame,
                           status_attributes: DataFrame, schedule: DataFrame, *,
                           ledger_statuses: DataFrame | None = None,
                           employer_id: int | None = None, as_of: dt.date = AS_OF) -> DataFrame:
    """``ledger_statuses``: the table that lists the statuses of the first-date block, where it is not the one with the
    payment attributes."""
    a = for_employer(agreements, employer_id)
    known = (status_attributes if ledger_statuses is None else ledger_statuses).select(norm("status").alias("_known"))
    l = ledger.join(known, norm("status") == F.col("_known"))
    first_ledger = (l.where(norm("status").isin("scheduled", "paid_payroll_deduction", "past_due"))
                     .join(a.select(F.col("id").alias("agreement_id"), "customer_id"), "agreement_id")
                     .groupBy("customer_id", "agreement_id")
                     .agg(F.min("transaction_date").alias("first_schedule_per_ledger")))
    model = schedule.groupBy("agreement_id").agg(
        F.min("schedule_date").alias("first_schedule_per_model"),
        F.sum(F.when(F.col("schedule_date") < lit_date(as_of), F.col("amount"))).alias("expected_per_model"))
    em = manifest.where(F.col("customer_id").isNotNull()).select("customer_id", "pay_frequency")
    pay_status = status_attributes.where(norm("count_as_payment") == "yes").select(norm("status").alias("_pays"))
    paid = (ledger.where(F.col("cancelled_at").isNull()).join(pay_status, norm("status") == F.col("_pays"))
                  .join(a.select(F.col("id").alias("agreement_id"), "customer_id"), "agreement_id")
                  .join(em.select("customer_id"), "customer_id")
                  .groupBy("agreement_id").agg(F.sum("amount").alias("paid_amount")))
    adim = a.select(F.col("id").alias("agreement_id"), "magento_order_number", "term", "sale_date",
                    F.col("date_created").alias("agreement_date"),
                    F.col("past_due_amount").alias("past_due_per_agreement"), F.col("customer_id").alias("_cid"))
    out = (first_ledger.join(model, "agreement_id", "left").join(paid, "agreement_id", "left")
                       .join(adim, "agreement_id")
                       .join(em.withColumnRenamed("customer_id", "_cid"), "_cid"))
    agree = F.when(F.col("first_schedule_per_model") == F.col("first_schedule_per_ledger"), "schedules agree") \
             .otherwise("schedules disagree")
    return out.select(
        "customer_id", "agreement_id", "first_schedule_per_ledger", "first_schedule_per_model",
        "expected_per_model", "magento_order_number", "term", "sale_date", "agreement_date", "pay_frequency",
        "past_due_per_agreement", "paid_amount",
        (F.coalesce("expected_per_model", F.lit(0)) + F.coalesce("paid_amount", F.lit(0))).alias("past_due_per_model"),
        agree.alias("schedule_starts_agree"))


_R12_DOMAIN = _R11_DOMAIN + ["ledger", "ledger_status_attributes"]


@register("schedule_start_compare", with_domain(_R12_DOMAIN, "WITH " + _R11_SQL + """,
booked AS (   -- one pass over the ledger rows with a listed status
  SELECT l.agreement_id AS id,
         min(l.transaction_date) FILTER (lower(rtrim(l.status)) IN ('past_due', 'paid_payroll_deduction', 'scheduled'))
           AS first_schedule_per_ledger,
         sum(l.amount) FILTER (l.cancelled_at IS NULL AND lower(rtrim(s.count_as_payment)) = 'yes') AS paid_once
  FROM ledger_status_attributes s JOIN ledger l ON lower(rtrim(l.status)) = lower(rtrim(s.status))
  GROUP BY l.agreement_id),
modelled AS (
  SELECT agreement_id AS id, min(schedule_date) AS first_schedule_per_model,
         sum(amount) FILTER (schedule_date < DATE '2001-06-30') AS expected_per_model
  FROM schedule GROUP BY agreement_id),
person AS (SELECT customer_id, pay_frequency, count(*) OVER (PARTITION BY customer_id) AS records FROM employee_manifest),
merged AS (
  SELECT ag.customer_id, id AS agreement_id, ag.magento_order_number, ag.term, ag.sale_date,
         ag.date_created AS agreement_date, ag.past_due_amount AS past_due_per_agreement, p.pay_frequency,
         b.first_schedule_per_ledger, m.first_schedule_per_model, m.expected_per_model,
         b.paid_once * p.records AS paid_amount
  FROM booked b JOIN agreements ag USING (id) JOIN person p USING (customer_id) LEFT JOIN modelled m USING (id)
  WHERE b.first_schedule_per_ledger IS NOT NULL)
SELECT *, ifnull(expected_per_model, 0) + ifnull(paid_amount, 0) AS past_due_per_model,
       if(first_schedule_per_model = first_schedule_per_ledger, 'schedules agree', 'schedules disagree')
         AS schedule_starts_agree
FROM merged
"""))
def _q_schedule_start_compare(spark, t):
    return schedule_start_compare(ledger_view(spark, t), d(spark, t, "agreements"),
                                  d(spark, t, "employee_manifest"), d(spark, t, "ledger_status_attributes"),
                                  _schedule(spark, t), as_of=AS_OF)


# ---------------------------------------------------------------------------------------------
# R13


def schedule_transactions(ledger: DataFrame, agreements: DataFrame, status_attributes: DataFrame, schedule: DataFrame, *,
                          employer_id: int | None = None) -> DataFrame:
    """Payments, model schedule and ledger schedule as one list of (agreement, dates, type, amount, source)."""
    booked, model = transaction_parts(ledger, agreements, status_attributes, schedule, employer_id=employer_id)
    return booked.unionByName(model)


def transaction_parts(ledger: DataFrame, agreements: DataFrame, status_attributes: DataFrame, schedule: DataFrame, *,
                      employer_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The list in two parts, the ledger's (payments and schedule) and the model's. Each keeps the partitioning of its input, which
    their union loses."""
    a_ids = for_employer(agreements, employer_id).select(F.col("id").alias("agreement_id"), F.col("status").alias("_astatus"))
    live = ledger.where(F.col("cancelled_at").isNull())
    # Payments and ledger schedule rows come from one scan of the ledger: each row emits a
    # payment entry, a schedule entry (sign flipped), both or none, depending on its status.
    flags = status_attributes.select(norm("status").alias("_flag"), (norm("count_as_payment") == "yes").alias("_pay"),
                                     (norm("include_in_schedule_calculation") == "yes").alias("_sched"))
    entry = F.explode(F.array(
        F.when(F.col("_pay"), F.struct(F.to_date("created_at").alias("effective_date"), F.col("amount").alias("amount"),
                                       F.lit("payments").alias("analysis_source"))),
        F.when(F.col("_sched") & (norm("_astatus") != "cancelled"),
               F.struct(F.col("transaction_date").alias("effective_date"), (-F.col("amount")).alias("amount"),
                        F.lit("schedule_ledger").alias("analysis_source")))))
    ledger_rows = (live.join(flags, norm("status") == F.col("_flag")).join(a_ids, "agreement_id")
                       .select("agreement_id", "transaction_date", "status", entry.alias("_e"))
                       .where(F.col("_e").isNotNull())
                       .select("agreement_id", F.col("_e.effective_date").alias("effective_date"), "transaction_date",
                               F.col("status").alias("transaction_type"), F.col("_e.amount").alias("amount"),
                               F.col("_e.analysis_source").alias("analysis_source")))
    model = schedule.select("agreement_id", F.col("schedule_date").alias("effective_date"),
                            F.col("schedule_date").alias("transaction_date"),
                            F.lit("schedule_model").alias("transaction_type"), "amount",
                            F.lit("schedule_model").alias("analysis_source"))
    return ledger_rows, model


def schedule_compare_detail(ledger: DataFrame, agreements: DataFrame, manifest: DataFrame,
                            paystubs: DataFrame, status_attributes: DataFrame, schedule: DataFrame, *,
                            employer_id: int | None = None, as_of: dt.date = AS_OF,
                            with_paystubs: DataFrame | None = None) -> DataFrame:
    a = for_employer(agreements, employer_id)
    parts = transaction_parts(ledger, agreements, status_attributes, schedule, employer_id=employer_id)
    aw = with_paystubs if with_paystubs is not None else \
        agreements_with_paystubs(agreements, manifest, paystubs, employer_id)
    adim = aw \
        .select("customer_id", "agreement_id", "magento_order_number", "agreement_status", "term",
                "date_created", "employee_manifest_id", "pay_frequency", "total_amount",
                "agreement_past_due_amt", "first_pay_date", "most_recent_pay_date")
    totals = a.groupBy("customer_id").agg(F.sum("past_due_amount").alias("total_customer_past_due"))
    src = F.col("analysis_source")
    # the customer's total meets the agreements; both parts meet them by agreement, where they lie already
    whole = adim.join(totals, "customer_id", "left")
    booked, model = (p.join(whole, "agreement_id", "left")
                      .select("customer_id", *p.columns, *[c for c in whole.columns if c not in ("customer_id", "agreement_id")]) for p in parts)
    return (booked.unionByName(model)
                .withColumn("transaction_timeframe",
                            F.when(F.col("effective_date") <= lit_date(as_of), "current_transactions")
                             .otherwise("future_transactions"))
                .withColumn("scheduled_amt_model", F.when(src == "schedule_model", F.col("amount")))
                .withColumn("scheduled_amt_ledger", F.when(src == "schedule_ledger", F.col("amount")))
                .withColumn("paid_amount", F.when(src == "payments", F.col("amount"))))


_R13_SQL = """,
movements AS (
  SELECT l.agreement_id, l.transaction_date, l.status AS transaction_type, e.analysis_source,
         if(e.analysis_source = 'payments', CAST(l.created_at AS DATE), l.transaction_date) AS effective_date,
         if(e.analysis_source = 'payments', l.amount, -l.amount) AS amount
  FROM ledger l
  JOIN agreements ag ON ag.id = l.agreement_id
  JOIN ledger_status_attributes s ON lower(rtrim(s.status)) = lower(rtrim(l.status))
  CROSS JOIN (VALUES ('payments'), ('schedule_ledger')) AS e(analysis_source)
  WHERE l.cancelled_at IS NULL
    AND if(e.analysis_source = 'payments', lower(rtrim(s.count_as_payment)) = 'yes',
           lower(rtrim(s.include_in_schedule_calculation)) = 'yes' AND lower(rtrim(ag.status)) <> 'cancelled')
  UNION ALL BY NAME
  SELECT agreement_id, schedule_date AS transaction_date, 'schedule_model' AS transaction_type,
         'schedule_model' AS analysis_source, schedule_date AS effective_date, amount
  FROM schedule),
detail AS (
  SELECT v.*, near.* EXCLUDE (agreement_id, total), near.total AS total_amount, ag.magento_order_number,
         ag.status AS agreement_status, ag.past_due_amount AS agreement_past_due_amt,
         (SELECT sum(o.past_due_amount) FROM agreements o WHERE o.customer_id = near.customer_id) AS total_customer_past_due,
         if(v.effective_date <= DATE '2001-06-30', 'current_transactions', 'future_transactions') AS transaction_timeframe,
         if(v.analysis_source = 'schedule_model', v.amount, NULL) AS scheduled_amt_model,
         if(v.analysis_source = 'schedule_ledger', v.amount, NULL) AS scheduled_amt_ledger,
         if(v.analysis_source = 'payments', v.amount, NULL) AS paid_amount
  FROM movements v LEFT JOIN near USING (agreement_id) LEFT JOIN agreements ag ON ag.id = near.agreement_id)
"""


def _detail(spark, t):
    """The schedule's plan is made where the agreements with their paystubs are read, row by row, unless it is a view already."""
    with_paystubs = _with_paystubs_view(spark, t)
    schedule = _schedule(spark, t) if has_view(t, "schedule") else instalments(_plan(spark, t))
    return schedule_compare_detail(ledger_view(spark, t), d(spark, t, "agreements"),
                                   d(spark, t, "employee_manifest"), d(spark, t, "employee_paystubs"),
                                   d(spark, t, "ledger_status_attributes"), schedule, as_of=AS_OF,
                                   with_paystubs=with_paystubs)


@register("schedule_compare_detail",
          with_domain(_R12_DOMAIN, "WITH " + _R11_SQL + _R13_SQL + "SELECT * FROM detail"))
def _q_schedule_compare_detail(spark, t):
    return _detail(spark, t)


# ---------------------------------------------------------------------------------------------
# R14


def past_due_reconcile(detail: DataFrame, manifest: DataFrame, department: DataFrame) -> DataFrame:
    cur = detail.where(F.col("transaction_timeframe") == "current_transactions")
    core = cur.groupBy("customer_id").agg(
        F.round(F.coalesce(F.max("total_customer_past_due"), F.lit(0)), 2).alias("past_due_per_agreements"),
        F.sum("scheduled_amt_model").alias("sum_scheduled_amt_model"),
        F.sum("scheduled_amt_ledger").alias("sum_scheduled_amt_ledger"),
        F.sum("paid_amount").alias("sum_paid_amount"))
    core = core.select(
        "*",
        F.round(F.coalesce("sum_scheduled_amt_model", F.lit(0)) + F.coalesce("sum_paid_amount", F.lit(0)), 2)
        .alias("past_due_per_model"),
        F.round(F.coalesce("sum_scheduled_amt_ledger", F.lit(0)) + F.coalesce("sum_paid_amount", F.lit(0)), 2)
        .alias("past_due_per_ledgers"))
    em = manifest.where(F.col("customer_id").isNotNull()).select("customer_id", "company_code", "employment_status")
    ed = department.select(F.col("department_prefix").alias("company_code"), F.col("status").alias("_dstatus"))
    j = core.join(em, "customer_id", "left").join(ed, "company_code", "left")
    ag, mo, le = F.col("past_due_per_agreements"), F.col("past_due_per_model"), F.col("past_due_per_ledgers")
    flag = lambda c: F.when(c > 0, 1).otherwise(0)
    return j.select(
        "customer_id", "past_due_per_agreements", "sum_scheduled_amt_model", "sum_scheduled_amt_ledger",
        "sum_paid_amount", "past_due_per_model", "past_due_per_ledgers",
        F.when(F.col("_dstatus") == "disconnected", "disconnected").otherwise(F.col("employment_status"))
        .alias("employee_status"),
        label([((ag == mo) & (ag == le), "Clean - all models agree"), (mo == le, "Model aligns with Ledgers"),
               (ag == le, "Ledgers Align with Agreements")], "Keep Investigating").alias("analysis_status"),
        label([(le > 0, "has_past_due_ledgers"), (mo > 0, "has_past_due_per_model"),
               (ag > 0, "has_past_due_per_agreements")], "not_past_due").alias("evaluate_for_past_due"),
        flag(le).alias("past_due_customer_per_ledger"), flag(mo).alias("past_due_customer_per_model"),
        flag(ag).alias("past_due_customer_per_agreements"))


@register("past_due_reconcile", with_domain(_R12_DOMAIN + ["employer_department"], "WITH " + _R11_SQL + _R13_SQL + """,
balance AS (
  SELECT customer_id, ifnull(max(total_customer_past_due), 0) AS agreements, sum(scheduled_amt_model) AS model,
         sum(scheduled_amt_ledger) AS booked, sum(paid_amount) AS paid
  FROM detail WHERE effective_date <= DATE '2001-06-30' GROUP BY customer_id),
due AS (
  SELECT customer_id, model AS sum_scheduled_amt_model, booked AS sum_scheduled_amt_ledger, paid AS sum_paid_amount,
         agreements AS past_due_per_agreements, ifnull(model, 0) + ifnull(paid, 0) AS past_due_per_model,
         ifnull(booked, 0) + ifnull(paid, 0) AS past_due_per_ledgers
  FROM balance),
place AS (
  SELECT em.customer_id, if(dep.status = 'disconnected', dep.status, em.employment_status) AS employee_status
  FROM employee_manifest em LEFT JOIN employer_department dep ON dep.department_prefix = em.company_code)
SELECT due.*, place.employee_status,
       CASE (past_due_per_model = past_due_per_ledgers, past_due_per_agreements = past_due_per_ledgers)
         WHEN (true, true) THEN 'Clean - all models agree' WHEN (true, false) THEN 'Model aligns with Ledgers'
         WHEN (false, true) THEN 'Ledgers Align with Agreements' ELSE 'Keep Investigating' END AS analysis_status,
       coalesce(if(past_due_per_ledgers > 0, 'has_past_due_ledgers', NULL),
                if(past_due_per_model > 0, 'has_past_due_per_model', NULL),
                if(past_due_per_agreements > 0, 'has_past_due_per_agreements', NULL), 'not_past_due') AS evaluate_for_past_due,
       CAST(past_due_per_ledgers > 0 AS INT) AS past_due_customer_per_ledger,
       CAST(past_due_per_model > 0 AS INT) AS past_due_customer_per_model,
       CAST(past_due_per_agreements > 0 AS INT) AS past_due_customer_per_agreements
FROM due LEFT JOIN place USING (customer_id)
"""))
def _q_past_due_reconcile(spark, t):
    return past_due_reconcile(_detail(spark, t), d(spark, t, "employee_manifest"),
                              d(spark, t, "employer_department"))
