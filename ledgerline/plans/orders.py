"""Order-level reports.

R03 ``order_history``: every agreement with customer, employer, scoring, ledger summary, bank
and pay-cycle attributes, risk bands and an adjusted past-due amount.
R09 ``returns_summary``: order items with agreement, employee, hierarchy and credit memo;
``multi_item_returns`` lists orders with more than one refunded item.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import label, local_date, max_if, prefix_before, sum_if, text_list, whole_units
from ..functions.money import exact_div
from ..operators import asc_key, latest_per_key, literal_table, sequence_per_key
from ..registry import register, with_domain
from .common import AS_OF, TZ, d, for_employer, lit_date, lit_ts, norm, sql_exact_div, sql_months_diff
from .employers import _CES_DOMAIN, _CES_SQL, _ces

AS_OF_TS = dt.datetime(2001, 6, 30, 3, 0, 0)
PAYMENT_STATUSES = ("paid_payroll_deduction", "initial_payment")

# ---------------------------------------------------------------------------------------------
# ledger views read by R03


def ledger_agreement_summary(ledger: DataFrame, *, as_of: dt.date = AS_OF) -> DataFrame:
    """Per agreement, in one pass over the ledger rows that are not cancelled: order total,
    payments, adjustments, pending, future scheduled amount, current balance, last payment
    date, initial payment, and amount / status / comment of the latest payment."""
    live = ledger.where(F.col("cancelled_at").isNull())
    st, amt, td = norm("status"), F.col("amount"), F.col("transaction_date")
    is_pay = st.isin(*PAYMENT_STATUSES)
    last = F.max_by(F.struct(amt.alias("amount"), F.col("status"), F.col("comment").alias("comment")),
                    F.when(is_pay, F.struct(td, F.col("id"))))
    return live.groupBy("agreement_id").agg(
        sum_if(st == "origination", amt).alias("order_total"),
        sum_if(is_pay, amt).alias("payments"),
        F.coalesce(sum_if(st == "return", amt), F.lit(0).cast("decimal(18,2)")).alias("adjustments"),
        sum_if(st == "past_due", amt).alias("pending"),
        sum_if((st == "scheduled") & (td > lit_date(as_of)), amt).alias("scheduled_future"),
        F.sum(amt).alias("current_balance"),
        max_if(is_pay, td).alias("last_payment_received"),
        F.round(sum_if(st == "initial_payment", amt), 2).alias("initial_payment"),
        last.alias("_last"))


_LEDGER_VIEWS_SQL = """
live AS (
  SELECT agreement_id, id, transaction_date, amount, status, comment, lower(rtrim(status)) AS st,
         lower(rtrim(status)) IN ('initial_payment', 'paid_payroll_deduction') AS pays
  FROM ledger WHERE cancelled_at IS NULL),
las AS (
  SELECT agreement_id, sum(amount) AS agreement_current_balance, sum(amount) FILTER (st = 'origination') AS order_total,
         sum(amount) FILTER (pays) AS payments, ifnull(sum(amount) FILTER (st = 'return'), 0) AS adjustments,
         sum(amount) FILTER (st = 'past_due') AS pending,
         sum(amount) FILTER (st = 'scheduled' AND transaction_date > DATE '2001-06-30') AS scheduled_future,
         sum(amount) FILTER (st = 'initial_payment') AS initial_payment,
         max(transaction_date) FILTER (pays) AS last_payment_received,
         first({'amount': amount, 'status': status, 'comment': comment} ORDER BY transaction_date DESC, id DESC)
           FILTER (pays) AS newest
  FROM live GROUP BY agreement_id)
"""

# fixed values: pay-cycle type -> longest cycle in days
CYCLE_MAX_DAYS = [("Bi-Weekly", 14), ("Monthly", 31), ("Semi-Monthly", 15), ("Weekly", 7)]

# ---------------------------------------------------------------------------------------------
# R03


def order_history(spark, summary: DataFrame, agreements: DataFrame, clarity: DataFrame, employer: DataFrame,
                  supplemental: DataFrame, signups: DataFrame, ledger: DataFrame, past_due: DataFrame,
                  customer: DataFrame, manifest: DataFrame, bank: DataFrame, *, as_of_ts: dt.datetime = AS_OF_TS,
                  tz: str = TZ, go_live_days: int = 30, include_sensitive: bool = False) -> DataFrame:
    as_of_date = as_of_ts.date()
    now = lit_ts(as_of_ts)
    today = lit_date(as_of_date)
    local_today = local_date(now, tz)
    las = ledger_agreement_summary(ledger, as_of=as_of_date).select(
        "*", F.col("_last.amount").alias("last_payment_amount"), F.col("_last.status").alias("last_payment_type"),
        F.col("_last.comment").alias("last_payment_comment")).drop("_last")
    a = agreements.select(F.col("id").alias("agreement_id"), "customer_id", "date_created", "magento_order_number",
                          "status", "total", "term", "payments")
    balances = (las.select("agreement_id", "current_balance")
                   .join(agreements.select(F.col("id").alias("agreement_id"), "customer_id"), "agreement_id")
                   .join(customer.select(F.col("entity_id").alias("customer_id")), "customer_id")
                   .groupBy("customer_id").agg(F.sum("current_balance").alias("customer_current_balance")))
    seq = sequence_per_key(agreements.select(F.col("id").alias("agreement_id"), "customer_id"), ["customer_id"],
                           [F.col("agreement_id")], "cust_order_sequence").drop("customer_id")
    em = manifest.where(F.col("customer_id").isNotNull())
    # accounts are told apart by their whole number and only then masked
    full = F.array_sort(F.collect_set("bank_account_number"))
    shown = full if include_sensitive else F.array_sort(F.transform(full, lambda x: F.concat(F.lit("XXXX"), F.substring(x, -4, 4))))
    banks = (em.select("customer_id", "employee_id", "employer_id")
               .join(bank, ["employee_id", "employer_id"])
               .join(customer.select(F.col("entity_id").alias("customer_id")), "customer_id")
               .groupBy("customer_id").agg(text_list(F.col("bank_routing_number"), ",").alias("bank_routings"),
                                           F.nullif(F.array_join(shown, ","), F.lit("")).alias("bank_accounts")))
    c = summary.select(
        F.col("entity_id").alias("customer_id"), "firstname", "lastname", "employer_name", "employer_detail_name",
        "salary", "employment_schedule", "start_date", "credit_limit", "first_order", "total_orders", "created_at",
        "customer_score", "employer_id", "employment_status", "deduction_due_days",
        prefix_before(F.col("pay_cycle"), ":").alias("cycle_type"))
    cc = clarity.select("customer_id", "clarity_score", "clear_credit_risk_score", "vantage_4_score")
    e = employer.select("employer_id", "scoring_model_type", "go_live_date")
    csu = (supplemental.select("customer_id", "customer_signup_id")
           .join(signups.select(F.col("id").alias("customer_signup_id"), F.col("salary").alias("salary_self_reported"),
                                F.col("tenure").alias("tenure_self_reported"),
                                F.col("employer_name").alias("employer_self_reported")), "customer_signup_id")
           .drop("customer_signup_id"))
    apd = past_due.select("agreement_id", F.col("amount").alias("past_due_amount"), "due_date")
    # customers and agreements are put together apart, so that an agreement's row moves once with all that it has
    buyer = (c.join(e, "employer_id", "left").join(cc, "customer_id", "left").join(csu, "customer_id", "left")
              .join(balances, "customer_id", "left").join(banks, "customer_id", "left"))
    order = (a.join(las.withColumnRenamed("payments", "las_payments")
                       .withColumnRenamed("current_balance", "agreement_current_balance"), "agreement_id", "left")
              .join(apd, "agreement_id", "left").join(seq, "agreement_id", "left"))
    j = (buyer.join(order, "customer_id")
          .withColumn("cycle_max_days", label([(F.col("cycle_type") == k, n) for k, n in CYCLE_MAX_DAYS])))
    col = F.col
    base = j.select(
        F.concat(col("firstname"), F.lit(" "), col("lastname")).alias("customer_name"),
        col("date_created").alias("agreement_created"), col("employer_name").alias("partner"), "employer_detail_name",
        "salary", col("employment_schedule").alias("ft_pt"),
        whole_units("MONTH", col("start_date"), now).alias("tenure_months"),
        "clarity_score", "clear_credit_risk_score", "vantage_4_score", "magento_order_number",
        col("status").alias("agreement_status"), col("credit_limit").alias("spending_limit"),
        (col("credit_limit") - col("customer_current_balance")).alias("customer_spending_limit_remaining"),
        col("total").alias("purchase_amount"), "order_total", col("las_payments").alias("payments"), "adjustments",
        "pending", "scheduled_future", "term", col("term").cast("bigint").alias("term_months"),
        col("payments").alias("payment_amt"), "first_order",
        (col("total_orders") - 1).alias("number_prior_purchases"), F.to_date("created_at").alias("registered_date"),
        col("customer_score").alias("bme_score"), "customer_current_balance", "agreement_current_balance",
        "last_payment_received", "agreement_id", "customer_id", "scoring_model_type", "go_live_date",
        "salary_self_reported", "tenure_self_reported", "employer_self_reported", "initial_payment",
        "cust_order_sequence", col("last_payment_received").alias("last_payment_received_date"),
        F.datediff(today, col("last_payment_received")).alias("days_since_payment"), "past_due_amount",
        F.datediff(today, col("due_date")).alias("days_past_due"),
        exact_div(-col("initial_payment"), col("total"), 6).alias("ip_pct"),
        col("start_date").alias("employee_start_date"),
        whole_units("MONTH", col("start_date"), col("date_created")).alias("tenure_months_at_order"),
        F.lit(1).alias("total_orders"), F.when(col("past_due_amount") > 0, 1).otherwise(0).alias("orders_past_due"),
        "employment_status", "bank_routings", "bank_accounts", "cycle_type", "cycle_max_days", "deduction_due_days",
        "last_payment_amount", "last_payment_type", "last_payment_comment")
    ip = col("ip_pct")
    ip_band = label([(ip.between(0.095, 0.105), "10_pct"), (ip.between(0.245, 0.255), "25_pct"),
                     (ip.between(0.495, 0.505), "50_pct")])
    tm = col("tenure_months_at_order")
    score = col("clear_credit_risk_score")
    dsp = col("days_since_payment")
    span = col("cycle_max_days") + col("deduction_due_days")
    latest_start = F.date_add(col("agreement_created"), span)
    bands = base.select(
        "*", ip_band.alias("ip_band"),
        F.coalesce(ip_band, F.lit("fast_track")).alias("fast_track_status"),
        label([(tm.between(0, 6), "0-6"), (tm.between(7, 9), "7-9"), (tm.between(10, 12), "10-12")], "12+")
        .alias("tenure_band_at_order"),
        label([(col("scoring_model_type") == "paystub_model", "paystub_model"),
               (score.isNull(), "base_model - no score required"), (score <= 500, "0-500"), (score <= 550, "501-550"),
               (score <= 575, "551-575"), (score <= 600, "576-600"), (score > 600, "600+")])
        .alias("clear_credit_risk_band"),
        label([(col("agreement_created") > F.date_sub(today, 15), "agreement within last 15 days"),
               (dsp > 120, "121+"), (dsp > 90, "91-120"), (dsp > 60, "61-90"), (dsp > 30, "31-60"),
               (dsp > 15, "15-30"), (dsp > 0, "0-30")], "no payments made").alias("days_since_payment_band"),
        span.alias("max_agreement_duration"), latest_start.alias("agreement_latest_start"),
        F.add_months(latest_start, col("term_months").cast("int")).alias("agreement_latest_end"))
    end, created = col("agreement_latest_end"), col("agreement_created")
    elapsed = label([(end <= created, F.lit(None).cast("decimal(28,4)")),
                     (local_today >= end, F.lit(1).cast("decimal(28,4)")),
                     (local_today <= created, F.lit(0).cast("decimal(28,4)"))],
                    exact_div(F.datediff(local_today, created), F.datediff(end, created), 4, unit=1))
    all_data = bands.select(
        "*", F.when(end < local_today, "Agreement Period Complete").otherwise("Agreement Period Still Open")
        .alias("agreement_period_evaluation"),
        elapsed.alias("pct_agreement_duration_elapsed"),
        exact_div(-(col("payments") + col("adjustments")), col("order_total"), 6).alias("pct_order_paid_off"),
        F.when(col("go_live_date") >= F.date_sub(today, go_live_days), "employer go-live within last 30 days")
        .otherwise("employer go-live over 30 days ago").alias("employer_go_live_category"))
    ladder = [
        (col("employer_go_live_category") == "employer go-live within last 30 days",
         col("past_due_amount"), "employer go-live within last 30 days"),
        (norm("employment_status") == "terminated", col("agreement_current_balance"), "terminated employee"),
        (col("agreement_period_evaluation") == "Agreement Period Complete", col("agreement_current_balance"),
         "Agreement Period Complete"),
        (dsp > col("cycle_max_days") * 2, col("agreement_current_balance"), "No payment in last two pay cycles"),
        (col("days_since_payment_band") == "no payments made", col("agreement_current_balance"), "No payments made"),
    ]
    return all_data.select(
        "*", label([(cnd, v) for cnd, v, _ in ladder], col("past_due_amount")).alias("past_due_amount_adjusted"),
        label([(cnd, r) for cnd, _, r in ladder], "Standard System Past-Due").alias("past_due_amount_adjusted_reason"))


_R03_DOMAIN = _CES_DOMAIN + ["scoring_clarity_score", "customer_supplemental", "customer_signups", "ledger",
                             "agreements_past_due", "customer_bank"]

_R03_SQL = "WITH " + _CES_SQL + "," + _LEDGER_VIEWS_SQL + f""",
clock AS (SELECT DATE '2001-06-30' AS today,
                 CAST(timezone('America/Chicago', timezone('UTC', TIMESTAMP '2001-06-30 03:00:00')) AS DATE) AS here),
owed AS (
  SELECT ag.customer_id, sum(las.agreement_current_balance) AS customer_current_balance
  FROM agreements ag JOIN las ON las.agreement_id = ag.id JOIN customer_entity c ON c.entity_id = ag.customer_id
  GROUP BY ag.customer_id),
accounts AS (
  SELECT em.customer_id, array_to_string(list_sort(list(DISTINCT cb.bank_routing_number)), ',') AS bank_routings,
         array_to_string(list_sort([concat('XXXX', right(x, 4)) for x in list(DISTINCT cb.bank_account_number)]), ',') AS bank_accounts
  FROM employee_manifest em JOIN customer_bank cb USING (employee_id, employer_id)
  WHERE em.customer_id IN (SELECT entity_id FROM customer_entity) GROUP BY em.customer_id),
cycles AS (FROM (VALUES ('Bi-Weekly', 14), ('Monthly', 31), ('Semi-Monthly', 15), ('Weekly', 7)) AS v(cycle_type, cycle_max_days)),
orders AS (   -- the agreement with everything known about its buyer; today's dates beside it
  SELECT ag.id AS agreement_id, ag.customer_id, ag.magento_order_number, ag.date_created AS agreement_created,
         ag.status AS agreement_status, ag.total AS purchase_amount, ag.term, CAST(ag.term AS BIGINT) AS term_months,
         ag.payments AS payment_amt,
         (SELECT count(*) FROM agreements o WHERE o.customer_id = ag.customer_id AND o.id <= ag.id) AS cust_order_sequence,
         c.firstname || ' ' || c.lastname AS customer_name, c.employer_name AS partner, c.employer_detail_name, c.salary,
         c.employment_schedule AS ft_pt, c.credit_limit AS spending_limit, c.first_order, c.start_date AS employee_start_date,
         c.total_orders - 1 AS number_prior_purchases, CAST(c.created_at AS DATE) AS registered_date, c.employment_status,
         c.customer_score AS bme_score, c.deduction_due_days,
         if(contains(c.pay_cycle, ':'), split_part(c.pay_cycle, ':', 1), '') AS cycle_type,
         cc.clarity_score, cc.clear_credit_risk_score, cc.vantage_4_score, e.scoring_model_type, e.go_live_date,
         su.salary AS salary_self_reported, su.tenure AS tenure_self_reported, su.employer_name AS employer_self_reported,
         due.amount AS past_due_amount, clock.today - due.due_date AS days_past_due,
         las.* EXCLUDE (agreement_id, newest), las.newest.amount AS last_payment_amount,
         las.newest.status AS last_payment_type, las.newest.comment AS last_payment_comment,
         las.last_payment_received AS last_payment_received_date,
         clock.today - las.last_payment_received AS days_since_payment, clock.*
  FROM clock, agreements ag
  JOIN ces c ON c.entity_id = ag.customer_id
  LEFT JOIN las ON las.agreement_id = ag.id LEFT JOIN agreements_past_due due ON due.agreement_id = ag.id
  LEFT JOIN employer e ON e.employer_id = c.employer_id LEFT JOIN scoring_clarity_score cc ON cc.customer_id = ag.customer_id
  LEFT JOIN customer_supplemental sp ON sp.customer_id = ag.customer_id
  LEFT JOIN customer_signups su ON su.id = sp.customer_signup_id),
measured AS (
  SELECT orders.*, cycle_max_days, owed.customer_current_balance, accounts.bank_routings, accounts.bank_accounts,
         spending_limit - owed.customer_current_balance AS customer_spending_limit_remaining,
         {sql_exact_div("-initial_payment", "purchase_amount", 6)} AS ip_pct,
         {sql_months_diff("employee_start_date", "today")} AS tenure_months,
         {sql_months_diff("employee_start_date", "agreement_created")} AS tenure_months_at_order,
         cycle_max_days + deduction_due_days AS max_agreement_duration,
         agreement_created + (cycle_max_days + deduction_due_days) AS agreement_latest_start,
         {sql_exact_div("-(payments + adjustments)", "order_total", 6)} AS pct_order_paid_off
  FROM orders LEFT JOIN cycles USING (cycle_type) LEFT JOIN owed USING (customer_id) LEFT JOIN accounts USING (customer_id)),
ended AS (
  SELECT measured.*, CAST(agreement_latest_start + to_months(CAST(term AS INT)) AS DATE) AS agreement_latest_end,
         CASE WHEN ip_pct BETWEEN 0.095 AND 0.105 THEN '10_pct' WHEN ip_pct BETWEEN 0.245 AND 0.255 THEN '25_pct'
              WHEN ip_pct BETWEEN 0.495 AND 0.505 THEN '50_pct' END AS ip_band,
         CASE WHEN scoring_model_type = 'paystub_model' THEN scoring_model_type
              WHEN clear_credit_risk_score IS NULL THEN 'base_model - no score required'
              ELSE (SELECT min_by(name, top) FROM (VALUES (500, '0-500'), (550, '501-550'), (575, '551-575'), (600, '576-600'),
                                                         (2147483647, '600+')) AS v(top, name)
                    WHERE clear_credit_risk_score <= top) END AS clear_credit_risk_band,
         CASE WHEN today - agreement_created < 15 THEN 'agreement within last 15 days'
              ELSE ifnull((SELECT max_by(name, above) FROM (VALUES (0, '0-30'), (15, '15-30'), (30, '31-60'), (60, '61-90'),
                                                                  (90, '91-120'), (120, '121+')) AS v(above, name)
                           WHERE days_since_payment > above), 'no payments made') END AS days_since_payment_band,
         ifnull((SELECT min_by(name, top) FROM (VALUES (6, '0-6'), (9, '7-9'), (12, '10-12')) AS v(top, name)
                 WHERE tenure_months_at_order >= 0 AND tenure_months_at_order <= top), '12+') AS tenure_band_at_order,
         'employer go-live ' || if(today - go_live_date <= 30, 'within last 30 days', 'over 30 days ago')
           AS employer_go_live_category
  FROM measured),
judged AS (
  SELECT *, CASE WHEN today - go_live_date <= 30 THEN 'employer go-live within last 30 days'
                 WHEN lower(rtrim(employment_status)) = 'terminated' THEN 'terminated employee'
                 WHEN here > agreement_latest_end THEN 'Agreement Period Complete'
                 WHEN days_since_payment > 2 * cycle_max_days THEN 'No payment in last two pay cycles'
                 WHEN days_since_payment_band = 'no payments made' THEN 'No payments made'
                 ELSE 'Standard System Past-Due' END AS past_due_amount_adjusted_reason
  FROM ended)
SELECT * EXCLUDE (today, here), 1 AS total_orders, CAST(ifnull(past_due_amount > 0, false) AS INT) AS orders_past_due,
       ifnull(ip_band, 'fast_track') AS fast_track_status,
       'Agreement Period ' || if(here > agreement_latest_end, 'Complete', 'Still Open') AS agreement_period_evaluation,
       -- elapsed share of the period, between 0 and 1; unknown for an empty period or an unknown end today
       CASE WHEN agreement_latest_end <= agreement_created THEN NULL WHEN here <= agreement_created AND NOT ifnull(here >= agreement_latest_end, false) THEN 0
            WHEN here >= agreement_latest_end THEN 1
            ELSE {sql_exact_div("(here - agreement_created)", "(agreement_latest_end - agreement_created)", 4, unit=1)} END
         AS pct_agreement_duration_elapsed,
       if(past_due_amount_adjusted_reason IN ('employer go-live within last 30 days', 'Standard System Past-Due'),
          past_due_amount, agreement_current_balance) AS past_due_amount_adjusted
FROM judged
"""


@register("order_history", with_domain(_R03_DOMAIN, _R03_SQL))
def _q_order_history(spark, t):
    return order_history(spark, _ces(spark, t), d(spark, t, "agreements"), d(spark, t, "scoring_clarity_score"),
                         d(spark, t, "employer"), d(spark, t, "customer_supplemental"), d(spark, t, "customer_signups"),
                         d(spark, t, "ledger"), d(spark, t, "agreements_past_due"), d(spark, t, "customer_entity"),
                         d(spark, t, "employee_manifest"), d(spark, t, "customer_bank"))


# ---------------------------------------------------------------------------------------------
# R09


def returns_summary(items: DataFrame, sales_order: DataFrame, agreements: DataFrame, employer: DataFrame,
                    manifest: DataFrame, hierarchy: DataFrame, supplemental: DataFrame, department: DataFrame,
                    calendar: DataFrame, creditmemo: DataFrame, *, employer_id: int | None = None) -> DataFrame:
    so = sales_order.select(F.col("entity_id").alias("order_id"))
    a = agreements.select("order_id", F.col("id").alias("agreement_id"), "magento_order_number",
                          F.col("status").alias("agreement_status"), "sale_date", "employer_id", "customer_id")
    e = employer.select("employer_id", F.col("name").alias("employer_name"))
    em = manifest.where(F.col("customer_id").isNotNull()).select(
        "customer_id", "employment_status", "start_date", "salary", "company_code",
        F.col("employer_id").alias("em_employer_id"))
    ed = department.select(F.col("department_prefix").alias("company_code"), F.col("status").alias("disconnect_status"))
    cs = supplemental.select("customer_id", "gender", "is_fast_track", "scoring_points_bme")
    cal = calendar.select("calendar_date", "week_start_date")
    cm = creditmemo.select("order_id", F.col("created_at").alias("returned_date_approximate"))
    soi = items.select("order_id", "item_id", "product_id", "sku", F.col("name").alias("product_name"), "qty_ordered",
                       "qty_refunded", "qty_shipped", "base_row_total", F.col("created_at").alias("sales_order_item_created"),
                       "amount_refunded", "fulfillment_cost", "fulfillment_shipping_cost",
                       F.coalesce("fulfillment_vendor", F.lit("unknown")).alias("fulfillment_vendor"))
    ed_cond = [em.company_code == ed.company_code]
    if employer_id is not None:
        ed_cond.append(em.em_employer_id == employer_id)   # left-side condition stays in ON: keeps the row
    # per customer, then per order; the items, many times as many, move by order and by item id alone
    buyer = em.join(ed, ed_cond, "left").drop(ed.company_code).join(cs, "customer_id", "left")
    order = a.join(e, "employer_id").join(buyer, "customer_id").join(so, "order_id").join(cm, "order_id", "left")
    j = soi.join(order, "order_id")
    j = (j.join(hierarchy, "item_id", "left")
          .join(cal, F.to_date(j.sales_order_item_created) == cal.calendar_date, "left"))
    ret = F.col("returned_date_approximate")
    return j.select(
        "order_id", "item_id", "product_id", "sku", "product_name", "qty_ordered", "qty_refunded", "qty_shipped",
        "base_row_total", "sales_order_item_created", "amount_refunded", "fulfillment_cost",
        "fulfillment_shipping_cost", "fulfillment_vendor", "agreement_id", "magento_order_number", "agreement_status",
        "sale_date", "employer_name", "employment_status", "disconnect_status", "start_date", "salary", "gender",
        "is_fast_track", "scoring_points_bme", "week_start_date", "returned_date_approximate",
        F.when(ret >= F.col("sale_date"), F.datediff(ret, F.col("sale_date"))).alias("days_purchase_to_return"),
        "category_l2", "category_l3", "category_l4", "category_l5", "category_l6",
        F.when(F.col("qty_refunded") > 0, "has_return").otherwise("no_return").alias("has_return"),
        F.when(F.col("qty_shipped") > 0, "has_shipped").otherwise("no_shipment").alias("has_shipped"))


def multi_item_returns(returns: DataFrame) -> DataFrame:
    return (returns.where(F.col("qty_refunded") > 0).groupBy("order_id")
                   .agg(F.count_distinct("item_id").alias("refunded_items")).where(F.col("refunded_items") > 1))


_R09_DOMAIN = ["sales_order_item", "sales_order", "agreements", "employer", "employee_manifest",
               "sales_order_item_product_hierarchy", "customer_supplemental", "employer_department", "calendar",
               "sales_creditmemo"]
_R09_SQL = """
WITH buyer AS (   -- what is known about the agreement of an order
  SELECT ag.order_id, ag.id AS agreement_id, ag.magento_order_number, ag.status AS agreement_status, ag.sale_date,
         e.name AS employer_name, em.employment_status, em.start_date, em.salary, dep.status AS disconnect_status,
         sp.gender, sp.is_fast_track, sp.scoring_points_bme, memo.created_at AS returned_date_approximate,
         if(memo.created_at >= ag.sale_date, CAST(memo.created_at AS DATE) - ag.sale_date, NULL) AS days_purchase_to_return
  FROM employee_manifest em
  JOIN agreements ag USING (customer_id) JOIN employer e ON e.employer_id = ag.employer_id
  SEMI JOIN sales_order so ON so.entity_id = ag.order_id
  LEFT JOIN customer_supplemental sp ON sp.customer_id = ag.customer_id
  LEFT JOIN employer_department dep ON dep.department_prefix = em.company_code
  LEFT JOIN sales_creditmemo memo ON memo.order_id = ag.order_id),
item AS (
  SELECT * EXCLUDE (name, created_at) REPLACE (ifnull(fulfillment_vendor, 'unknown') AS fulfillment_vendor),
         name AS product_name, created_at AS sales_order_item_created, CAST(created_at AS DATE) AS calendar_date
  FROM sales_order_item),
core AS (
  SELECT item.* EXCLUDE (calendar_date), buyer.* EXCLUDE (order_id), calendar.week_start_date, kind.* EXCLUDE (item_id)
  FROM item JOIN buyer USING (order_id)
  LEFT JOIN calendar USING (calendar_date) LEFT JOIN sales_order_item_product_hierarchy kind USING (item_id))
"""


def _returns(spark, t):
    return returns_summary(*(d(spark, t, n) for n in _R09_DOMAIN))


@register("returns_summary", with_domain(_R09_DOMAIN, _R09_SQL + """
SELECT *, if(qty_refunded > 0, 'has_return', 'no_return') AS has_return,
       if(qty_shipped > 0, 'has_shipped', 'no_shipment') AS has_shipped
FROM core
"""))
def _q_returns_summary(spark, t):
    return _returns(spark, t)


@register("multi_item_returns", with_domain(_R09_DOMAIN, _R09_SQL + """
SELECT * FROM (SELECT order_id, count(DISTINCT item_id) FILTER (qty_refunded > 0) AS refunded_items FROM core GROUP BY order_id)
WHERE refunded_items > 1
"""))
def _q_multi_item_returns(spark, t):
    return multi_item_returns(_returns(spark, t))
