"""Employer-side reports.

``customer_entity_summary``: the customer summary view several reports read (customer, employee
row, employer, sub-employer, order totals).
R04 ``schedule_tieout``: active employees whose last pay cutoff has passed.
R05 ``pay_periods``: company pay periods with their JSON fields as columns.
R19 ``pay_frequency_infer``: pay frequency inferred from gaps between paystubs.
R21/R22 ``sub_employer_summary``: employees and orders per sub-employer.
R23 ``sub_employer_growth``: signed +1/-1 sub-employer events with order totals.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import label
from ..operators import gaps
from ..registry import register, with_domain
from .common import AS_OF, TZ, d, for_employer, lit_date, norm

# ---------------------------------------------------------------------------------------------
# customer summary view


def customer_entity_summary(customer: DataFrame, manifest: DataFrame, employer: DataFrame,
                            department: DataFrame, agreements: DataFrame) -> DataFrame:
    orders = agreements.groupBy("customer_id").agg(
        F.count("*").alias("_n"), F.sum("total").alias("total_order_dollars"),
        F.min("date_created").alias("first_order"))
    em = manifest.where(F.col("customer_id").isNotNull()).select(
        F.col("customer_id").alias("entity_id"), "company_code", "salary", "employment_schedule", "start_date",
        "pay_cycle", "employment_status", "pay_frequency")
    e = employer.select("employer_id", F.col("name").alias("employer_name"))
    ed = department.select(F.col("department_prefix").alias("company_code"),
                           F.col("department_name").alias("employer_detail_name"))
    c = customer.select("entity_id", "employer_id", "firstname", "lastname", "email", "credit_limit", "created_at",
                        "customer_score", "deduction_due_days")
    return (c.join(em, "entity_id", "left").join(e, "employer_id", "left").join(ed, "company_code", "left")
             .join(orders.withColumnRenamed("customer_id", "entity_id"), "entity_id", "left")
             .withColumn("total_orders", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")).drop("_n"))


_CES_DOMAIN = ["customer_entity", "employee_manifest", "employer", "employer_department", "agreements"]
_CES_SQL = """
ces AS (
  SELECT c.entity_id, c.employer_id, c.firstname, c.lastname, c.email, c.credit_limit, c.created_at,
         c.customer_score, c.deduction_due_days, em.company_code, em.salary, em.employment_schedule,
         em.start_date, em.pay_cycle, em.employment_status, em.pay_frequency, e.name AS employer_name,
         ed.department_name AS employer_detail_name, o.total_order_dollars, o.first_order,
         CAST(coalesce(o.n, 0) AS BIGINT) AS total_orders
  FROM customer_entity c
  LEFT JOIN employee_manifest em ON em.customer_id = c.entity_id
  LEFT JOIN employer e ON e.employer_id = c.employer_id
  LEFT JOIN employer_department ed ON ed.department_prefix = em.company_code
  LEFT JOIN (SELECT customer_id, count(*) AS n, sum(total) AS total_order_dollars, min(date_created) AS first_order
             FROM agreements GROUP BY customer_id) o ON o.customer_id = c.entity_id)
"""


def _ces(spark, t):
    return customer_entity_summary(*(d(spark, t, n) for n in _CES_DOMAIN))


# ---------------------------------------------------------------------------------------------
# R04

DEFAULT_CUTOFF = dt.date(2001, 1, 1)


def schedule_tieout(customer: DataFrame, manifest: DataFrame, department: DataFrame, cycle_days: DataFrame,
                    paystubs: DataFrame, *, employer_id: int | None = None, as_of: dt.date = AS_OF,
                    default_cutoff: dt.date = DEFAULT_CUTOFF) -> DataFrame:
    c = for_employer(customer, employer_id).select(F.col("entity_id").alias("customer_id"), "missing_last_paystub")
    em = manifest.where(norm("employment_status") != "terminated").select(
        "customer_id", F.col("id").alias("employee_manifest_id"), "company_code", "pay_frequency")
    ed = department.where(norm("status") != "disconnected").select(F.col("department_prefix").alias("company_code"))
    cd = cycle_days.select("pay_frequency", "pay_frequency_cycle_days_w_buffer")
    lp = paystubs.groupBy("employee_manifest_id").agg(F.max("pay_date").alias("last_pay_date"))
    core = (c.join(em, "customer_id").join(ed, "company_code").join(cd, "pay_frequency", "left")
             .join(lp, "employee_manifest_id", "left")
             .select("customer_id", "employee_manifest_id", "last_pay_date",
                     F.date_add("last_pay_date", F.col("pay_frequency_cycle_days_w_buffer")).alias("last_pay_cutoff"),
                     "missing_last_paystub"))
    return core.where((F.coalesce("last_pay_cutoff", lit_date(default_cutoff)) < lit_date(as_of))
                      & (F.coalesce("missing_last_paystub", F.lit(0)) != 1))


@register("schedule_tieout", with_domain(
    ["customer_entity", "employee_manifest", "employer_department", "pay_frequency_cycle_days", "employee_paystubs"], """
WITH watched AS (
  SELECT c.entity_id AS customer_id, em.id AS employee_manifest_id, c.missing_last_paystub, em.pay_frequency,
         (SELECT max(p.pay_date) FROM employee_paystubs p WHERE p.employee_manifest_id = em.id) AS last_pay_date
  FROM employer_department dep, employee_manifest em, customer_entity c
  WHERE dep.department_prefix = em.company_code AND c.entity_id = em.customer_id
    AND lower(rtrim(dep.status)) <> 'disconnected' AND lower(rtrim(em.employment_status)) <> 'terminated'
    AND c.missing_last_paystub IS DISTINCT FROM 1)
SELECT w.* EXCLUDE (pay_frequency), w.last_pay_date + k.pay_frequency_cycle_days_w_buffer AS last_pay_cutoff
FROM watched w LEFT JOIN pay_frequency_cycle_days k USING (pay_frequency)
-- an unknown cutoff counts as the default one, which has passed
WHERE (w.last_pay_date + k.pay_frequency_cycle_days_w_buffer < DATE '2001-06-30') IS NOT FALSE
"""))
def _q_schedule_tieout(spark, t):
    return schedule_tieout(d(spark, t, "customer_entity"), d(spark, t, "employee_manifest"),
                           d(spark, t, "employer_department"), d(spark, t, "pay_frequency_cycle_days"),
                           d(spark, t, "employee_paystubs"))


# ---------------------------------------------------------------------------------------------
# R05

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def pay_periods(company_payperiods: DataFrame) -> DataFrame:
    raw = F.col("raw_data")

    def ts(path):
        return F.try_to_timestamp(F.get_json_object(raw, path), F.lit(ISO_Z)).cast("timestamp_ntz")
    return company_payperiods.select(
        "id", "employer_id", "company_id", "pay_period_id", "check_date",
        F.get_json_object(raw, "$.intervalCode").alias("interval_code"), "status",
        F.get_json_object(raw, "$.description").alias("description"),
        ts("$.startDate").alias("start_date"), ts("$.endDate").alias("end_date"),
        ts("$.submitByDate").alias("submit_by_date"), "num_checks", "completed_at", "raw_data")


@register("pay_periods", with_domain(["company_payperiods"], """
SELECT id, employer_id, company_id, pay_period_id, check_date,
       json_extract_string(raw_data, '$.intervalCode') AS interval_code, status,
       json_extract_string(raw_data, '$.description') AS description,
       try_strptime(json_extract_string(raw_data, '$.startDate'), '%Y-%m-%dT%H:%M:%SZ') AS start_date,
       try_strptime(json_extract_string(raw_data, '$.endDate'), '%Y-%m-%dT%H:%M:%SZ') AS end_date,
       try_strptime(json_extract_string(raw_data, '$.submitByDate'), '%Y-%m-%dT%H:%M:%SZ') AS submit_by_date,
       num_checks, completed_at, raw_data
FROM company_payperiods
"""))
def _q_pay_periods(spark, t):
    return pay_periods(d(spark, t, "company_payperiods"))


# ---------------------------------------------------------------------------------------------
# R19

SINCE = dt.date(1995, 1, 1)


def _half_up_ratio(num, den, scale: int):
    """round(num / den, scale) half-up, exactly, for non-negative integers (NULL when den = 0)."""
    k = 10 ** scale
    q = F.call_function("div", num * (2 * k) + den, F.when(den != 0, den * 2))
    return F.when(den != 0, (q.cast("decimal(38,0)") / k).cast(f"decimal(18,{scale})"))


def pay_frequency_infer(manifest: DataFrame, paystubs: DataFrame, summary: DataFrame, *,
                        employer_id: int | None = None, since: dt.date = SINCE, min_stubs: int = 4,
                        ordered: bool = False) -> DataFrame:
    """``ordered=True`` sorts by employee id (a global range sort; off by default)."""
    em_ids = for_employer(manifest, employer_id).select(F.col("id").alias("employee_manifest_id"))
    stubs = paystubs.where(F.col("pay_date") >= lit_date(since)).join(em_ids, "employee_manifest_id") \
                    .select("employee_manifest_id", "pay_date")
    g = gaps(stubs, ["employee_manifest_id"], "pay_date")
    # The stubs are read once: counted per (employee, gap), the first stub's gap being NULL. The modal gap, every gap
    # statistic and the stub totals come from those counts; the days of the month are sets of at most 31.
    counted = g.groupBy("employee_manifest_id", "gap_days").agg(
        F.count("*").alias("_n"), F.min("pay_date").alias("_first"), F.max("pay_date").alias("_last"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth("pay_date"))).alias("_days"))
    gap, n = F.col("gap_days").cast("bigint"), F.col("_n")
    known = F.col("gap_days").isNotNull()
    s = counted.groupBy("employee_manifest_id").agg(
        F.sum(n).alias("n_paystubs"), F.min("_first").alias("first_pay"), F.max("_last").alias("last_pay"),
        F.bit_count(F.bit_or("_days")).cast("bigint").alias("distinct_dom"),
        F.min("gap_days").alias("min_gap"), F.max("gap_days").alias("max_gap"),
        F.sum(gap * n).alias("_sum"), F.sum(F.when(known, n)).alias("_cnt"), F.sum(gap * gap * n).alias("_sq"),
        F.max_by(F.col("gap_days"), F.when(known, F.struct(n, -F.col("gap_days")))).alias("modal_gap"))
    cnt = F.col("_cnt")
    var = (cnt * F.col("_sq") - F.col("_sum") * F.col("_sum")).cast("double") / (cnt * cnt).cast("double")
    s = s.withColumns({"span_days": F.datediff("last_pay", "first_pay"),
                       "avg_gap": _half_up_ratio(F.col("_sum"), cnt, 1), "sd_gap": F.round(F.sqrt(var), 2)})
    e = for_employer(manifest, employer_id).select(F.col("id").alias("employee_manifest_id"), "customer_id",
                                                   "pay_frequency")
    ces = summary.where(F.col("total_orders") > 0).select(F.col("entity_id").alias("customer_id"))
    j = e.join(ces, "customer_id").join(s, "employee_manifest_id", "left")
    # implied paychecks per year: round(round(n / span, 4) * 365, 1), exact decimal arithmetic
    span = F.col("span_days")
    q4 = F.call_function("div", F.col("n_paystubs") * 20000 + span, F.when(span != 0, span * 2))
    implied = F.when(span != 0, (F.call_function("div", q4 * 730 + 1000, F.lit(2000)).cast("decimal(38,0)") / 10).cast("decimal(18,1)"))
    mg = F.col("modal_gap")
    biweekly_or_semi = label([(F.col("max_gap") < 15, "Bi-Weekly"),
                              ((F.col("distinct_dom") <= 12) & (F.col("n_paystubs") >= 8), "Semi-Monthly"),
                              (F.col("distinct_dom") > 12, "Bi-Weekly")], "Ambiguous")
    inferred = label([((F.col("n_paystubs") < min_stubs) | mg.isNull(), "Insufficient"),
                      (mg.between(6, 8), "Weekly"), (mg.between(13, 16), biweekly_or_semi),
                      (mg.between(27, 35), "Monthly")], "Unknown")
    out = j.select(
        "employee_manifest_id", "pay_frequency", "n_paystubs", "first_pay", "last_pay", "span_days", "min_gap",
        "modal_gap", "avg_gap", "max_gap", "sd_gap", "distinct_dom", implied.alias("implied_per_year"),
        inferred.alias("pay_frequency_inferred"), F.col("pay_frequency").alias("pay_frequency_actual"),
        F.when(F.col("n_paystubs") < min_stubs, "INSUFFICIENT_DATA").alias("data_quality_flag"))
    return out.orderBy("employee_manifest_id") if ordered else out


@register("pay_frequency_infer", with_domain(_CES_DOMAIN + ["employee_paystubs"], "WITH " + _CES_SQL + """,
stub AS (
  SELECT employee_manifest_id AS id, pay_date,
         pay_date - lag(pay_date) OVER (PARTITION BY employee_manifest_id ORDER BY pay_date) AS gap
  FROM employee_paystubs WHERE pay_date >= DATE '1995-01-01'),
facts AS (
  SELECT id, count(*) AS n_paystubs, min(pay_date) AS first_pay, max(pay_date) AS last_pay,
         max(pay_date) - min(pay_date) AS span_days, count(DISTINCT day(pay_date)) AS distinct_dom,
         min(gap) AS min_gap, max(gap) AS max_gap, CAST(avg(gap) AS DECIMAL(18,1)) AS avg_gap,
         round(stddev_pop(gap), 2) AS sd_gap
  FROM stub GROUP BY id),
modes AS (
  SELECT id, first(gap ORDER BY times DESC, gap) AS modal_gap
  FROM (SELECT id, gap, count(*) AS times FROM stub WHERE gap IS NOT NULL GROUP BY id, gap) GROUP BY id),
named AS (
  SELECT id, CASE WHEN modal_gap BETWEEN 6 AND 8 THEN 'Weekly' WHEN modal_gap BETWEEN 27 AND 35 THEN 'Monthly'
                  WHEN modal_gap NOT BETWEEN 13 AND 16 THEN 'Unknown'
                  -- gaps near two weeks: short longest gap, or many different days of the month, is every 14 days
                  WHEN max_gap < 15 OR distinct_dom > 12 THEN 'Bi-Weekly'
                  WHEN n_paystubs >= 8 THEN 'Semi-Monthly' ELSE 'Ambiguous' END AS by_gap
  FROM facts JOIN modes USING (id))
SELECT em.id AS employee_manifest_id, em.pay_frequency, f.* EXCLUDE (id), m.modal_gap,
       round(CAST(f.n_paystubs / nullif(f.span_days, 0) AS DECIMAL(18,4)) * 365, 1) AS implied_per_year,
       CASE WHEN f.id IS NULL THEN 'Insufficient' WHEN f.n_paystubs >= 4 THEN coalesce(n.by_gap, 'Insufficient')
            ELSE 'Insufficient' END AS pay_frequency_inferred,
       em.pay_frequency AS pay_frequency_actual, if(f.n_paystubs < 4, 'INSUFFICIENT_DATA', NULL) AS data_quality_flag
FROM employee_manifest em
JOIN ces ON ces.entity_id = em.customer_id AND ces.total_orders > 0
LEFT JOIN facts f ON f.id = em.id LEFT JOIN modes m ON m.id = em.id LEFT JOIN named n ON n.id = em.id
"""))
def _q_pay_frequency_infer(spark, t):
    return pay_frequency_infer(d(spark, t, "employee_manifest"), d(spark, t, "employee_paystubs"), _ces(spark, t))


# ---------------------------------------------------------------------------------------------
# R21 / R22


def sub_employer_summary(manifest: DataFrame, summary: DataFrame, sub_employer: DataFrame, *,
                         employer_id: int | None = None, inactive_flag: bool = True) -> DataFrame:
    s = norm("employment_status")
    se = for_employer(manifest, employer_id).groupBy("company_code", F.col("location").alias("sub_employer_name")).agg(
        F.lit(1).alias("sub_employer_count"), F.count("*").alias("total_employees"),
        F.sum(F.when(s == "terminated", 1)).alias("terminated_employees"),
        F.sum(F.when(s != "terminated", 1)).alias("active_employees"))
    orders = for_employer(summary, employer_id).groupBy("employer_id", "company_code").agg(
        F.sum(F.when(F.col("total_orders") > 0, 1)).alias("employees_with_orders"),
        F.sum("total_orders").alias("total_order_count"), F.sum("total_order_dollars").alias("total_order_value"))
    es = sub_employer.select("company_code", "sub_employer_status")
    j = se.join(es, "company_code", "left").join(orders.drop("employer_id"), "company_code", "left")
    st, n = norm("sub_employer_status"), F.col("total_order_count")
    cols = [*se.columns, "sub_employer_status", "employees_with_orders", "total_order_count", "total_order_value",
            F.when(st == "active", 1).alias("active_count"), F.when(st != "active", 1).alias("inactive_count"),
            F.when(n > 0, 1).alias("sub_employer_has_orders")]
    if inactive_flag:
        cols.append(F.when((n > 0) & (st != "active"), 1).alias("sub_employer_inactive_has_orders"))
    return j.select(*cols)


_SUB_SQL = """,
headcount AS (
  SELECT company_code, location AS sub_employer_name, count(*) AS total_employees,
         nullif(count(*) FILTER (lower(rtrim(employment_status)) = 'terminated'), 0) AS terminated_employees,
         nullif(count(*) FILTER (lower(rtrim(employment_status)) <> 'terminated'), 0) AS active_employees
  FROM employee_manifest GROUP BY company_code, location),
buying AS (
  SELECT company_code, nullif(count(*) FILTER (total_orders > 0), 0) AS employees_with_orders,
         sum(total_orders) AS total_order_count, sum(total_order_dollars) AS total_order_value
  FROM ces GROUP BY employer_id, company_code),
standing AS (
  SELECT company_code, sub_employer_status, lower(rtrim(sub_employer_status)) = 'active' AS is_active
  FROM employer_subemployer_detail)
SELECT h.*, 1 AS sub_employer_count, s.sub_employer_status, b.* EXCLUDE (company_code),
       nullif(CAST(s.is_active AS INT), 0) AS active_count, nullif(CAST(NOT s.is_active AS INT), 0) AS inactive_count,
       nullif(CAST(b.total_order_count > 0 AS INT), 0) AS sub_employer_has_orders{extra}
FROM headcount h LEFT JOIN standing s USING (company_code) LEFT JOIN buying b USING (company_code)
"""
_SUB_DOMAIN = _CES_DOMAIN + ["employer_subemployer_detail"]


@register("sub_employer_summary", with_domain(_SUB_DOMAIN, "WITH " + _CES_SQL + _SUB_SQL.format(extra=""",
       if(NOT s.is_active AND b.total_order_count > 0, 1, NULL) AS sub_employer_inactive_has_orders""")))
def _q_sub_employer_summary(spark, t):
    return sub_employer_summary(d(spark, t, "employee_manifest"), _ces(spark, t),
                                d(spark, t, "employer_subemployer_detail"))


@register("sub_employer_summary_basic", with_domain(_SUB_DOMAIN, "WITH " + _CES_SQL + _SUB_SQL.format(extra="")))
def _q_sub_employer_summary_basic(spark, t):
    return sub_employer_summary(d(spark, t, "employee_manifest"), _ces(spark, t),
                                d(spark, t, "employer_subemployer_detail"), inactive_flag=False)


# ---------------------------------------------------------------------------------------------
# R23


def sub_employer_growth(sub_employer: DataFrame, history: DataFrame, summary: DataFrame, *,
                        employer_id: int | None = None, tz: str = TZ) -> DataFrame:
    def cst(c):
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(c))
    added = for_employer(sub_employer, employer_id).select(
        "company_code", cst("sub_employer_created_at").alias("event_date"), F.col("sub_employer_status").alias("status"),
        F.lit("added").alias("event_type"), F.lit(1).alias("sub_employer_count"))
    updated = history.select(   # no employer filter on this branch, as in the source
        F.col("department_prefix").alias("company_code"), cst("created_at").alias("event_date"), "status",
        F.lit("updated").alias("event_type"),
        F.when(norm("status") != "active", -1).otherwise(1).alias("sub_employer_count"))
    core = added.unionByName(updated)
    se = sub_employer.select("company_code", "sub_employer_name")
    orders = (for_employer(summary, employer_id).where(F.col("total_orders") > 0).groupBy("company_code")
              .agg(F.sum("total_orders").alias("total_orders"), F.sum("total_order_dollars").alias("total_order_dollars"),
                   F.count("*").alias("total_employees_with_orders")))
    return (core.join(se, "company_code", "left").join(orders, "company_code", "left")
                .select(*core.columns, "sub_employer_name", "total_orders", "total_order_dollars",
                        "total_employees_with_orders",
                        F.when(F.col("total_orders") > 0, "has_orders").otherwise("no_orders").alias("has_orders")))


@register("sub_employer_growth", with_domain(_SUB_DOMAIN + ["employer_department_history"], "WITH " + _CES_SQL + """,
happened AS (
  SELECT 'added' AS event_type, company_code, sub_employer_status AS status, sub_employer_created_at AS utc
  FROM employer_subemployer_detail
  UNION ALL BY NAME
  SELECT 'updated' AS event_type, department_prefix AS company_code, status, created_at AS utc
  FROM employer_department_history),
buying AS (
  SELECT company_code, sum(total_orders) AS total_orders, sum(total_order_dollars) AS total_order_dollars,
         count(*) AS total_employees_with_orders
  FROM ces WHERE total_orders > 0 GROUP BY company_code)
SELECT h.* EXCLUDE (utc), timezone('America/Chicago', timezone('UTC', h.utc)) AS event_date,
       if(h.event_type = 'updated' AND lower(rtrim(h.status)) <> 'active', -1, 1) AS sub_employer_count,
       s.sub_employer_name, b.* EXCLUDE (company_code), if(b.total_orders > 0, 'has_orders', 'no_orders') AS has_orders
FROM happened h
LEFT JOIN employer_subemployer_detail s USING (company_code)
LEFT JOIN buying b USING (company_code)
"""))
def _q_sub_employer_growth(spark, t):
    return sub_employer_growth(d(spark, t, "employer_subemployer_detail"), d(spark, t, "employer_department_history"),
                               _ces(spark, t))
