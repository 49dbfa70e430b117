"""Domain tables derived from the driver's Parquet tables.

Each adapter is one SELECT written in the SQL subset shared by Spark SQL and DuckDB, with
``{table}`` placeholders for its inputs. Spark runs it through ``spark.sql(text, table=df)``
(the DataFrames are bound as parameters, no global views); the DuckDB oracle uses the same text
as a leading CTE. So the report code and its oracle start from identical domain rows, and only
the report logic differs between the two engines.

The mappings (which driver column plays which domain column) are listed in FIXTURES.md.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Adapter:
    name: str
    sql: str

    @property
    def inputs(self) -> list[str]:
        return sorted(set(re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", self.sql)))

    def spark(self, spark: SparkSession, tables) -> DataFrame:
        """Parse and analyse the SELECT with TIMESTAMP meaning TIMESTAMP_NTZ, so domain timestamps
        are wall-clock values (as in the oracle) whatever the caller's session time zone is. The
        caller's setting is restored right after; the analysed plan keeps the types."""
        key = "spark.sql.timestampType"
        old = spark.conf.get(key, None)
        spark.conf.set(key, "TIMESTAMP_NTZ")
        try:
            df = spark.sql(self.sql, **{t: tables[t] for t in self.inputs})
            df.schema  # noqa: B018  (force analysis while the setting is active)
        finally:
            if old is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, old)
        return df

    def duckdb(self) -> str:
        return self.sql.format(**{t: t for t in self.inputs})


ADAPTERS: dict[str, Adapter] = {}


def _adapter(name: str, sql: str) -> None:
    ADAPTERS[name] = Adapter(name, sql.strip())


# --- fixed values of the programme ------------------------------------------------------------
# Pay frequencies and their cycle lengths in days (approximate cycle, cycle with buffer).
#   Weekly 7 / 10, Bi-Weekly 14 / 17, Semi-Monthly 15 / 18, Monthly 30 / 34
# Ledger statuses and their attributes (count_as_payment, include_in_schedule_calculation,
# include_in_balance_calculation, ledger_stage, ledger_stage_category):
#   scheduled              No  Yes Yes scheduled   schedule
#   paid_payroll_deduction Yes No  Yes paid        payment
#   past_due               No  Yes Yes past_due    schedule
#   Origination            No  No  Yes origination origination
#   initial_payment        Yes No  Yes paid        payment

_adapter("customer_entity", """
SELECT c_custkey AS entity_id,
       c_nationkey AS employer_id,
       'First' || CAST(c_custkey AS STRING) AS firstname,
       c_mktsegment AS lastname,
       lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.com' AS email,
       DATE '1960-01-01' + CAST(c_custkey % 9000 AS INT) AS dob,
       CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1 END AS status,
       CAST(c_acctbal AS DECIMAL(18,2)) AS credit_limit,
       CASE c_custkey % 9 WHEN 0 THEN 'Paychex' WHEN 1 THEN 'paychex' ELSE 'Web' END AS created_in,
       CASE WHEN c_custkey % 10 = 0 THEN 1 END AS missing_last_paystub,
       CAST(DATE '1994-06-01' + CAST(c_custkey % 365 AS INT) AS TIMESTAMP) AS created_at,
       CAST(550 + c_custkey % 300 AS INT) AS customer_score,
       CAST(5 + c_custkey % 10 AS INT) AS deduction_due_days,
       CASE WHEN c_custkey % 17 = 0 THEN '1' ELSE '0' END AS deduction_code_blocked,
       DATE '2001-07-01' + CAST(c_custkey % 14 AS INT) AS next_pay_date
FROM {customer}
""")

_adapter("employer", """
SELECT n_nationkey AS employer_id,
       n_name AS name,
       CASE n_nationkey % 3 WHEN 0 THEN 'paystub_model' WHEN 1 THEN 'base_model' ELSE 'credit_model' END
         AS scoring_model_type,
       DATE '1995-01-01' + CAST(100 * n_nationkey AS INT) AS go_live_date,
       '{{"immutable_at": "' || CAST(DATE '1996-01-01' + CAST(60 * n_nationkey AS INT) AS STRING) || ' 00:00:00"}}'
         AS additional_data
FROM {nation}
""")

_adapter("employee_manifest", """
SELECT c_custkey + 1000000 AS id,
       CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_custkey END AS customer_id,
       c_nationkey AS employer_id,
       c_custkey + 5000000 AS employee_id,
       'W' || CAST(c_custkey AS STRING) AS worker_id,
       'C' || CAST(c_nationkey AS STRING) || '_' || CAST(c_custkey % 3 AS STRING) AS company_code,
       'First' || CAST(c_custkey AS STRING) AS first_name,
       c_mktsegment AS last_name,
       lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.com' AS email,
       CASE c_custkey % 4 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Bi-Weekly' WHEN 2 THEN 'Semi-Monthly'
            ELSE 'Monthly' END AS pay_frequency,
       CASE WHEN c_custkey % 13 = 0 THEN
              CASE c_custkey % 4 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Bi-Weekly' WHEN 2 THEN 'Semi-Monthly'
                   ELSE 'Monthly' END
            ELSE
              CASE c_custkey % 4 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Bi-Weekly' WHEN 2 THEN 'Semi-Monthly'
                   ELSE 'Monthly' END || ':' || CASE c_custkey % 2 WHEN 0 THEN 'Friday' ELSE 'Thursday' END
       END AS pay_cycle,
       CASE c_custkey % 7 WHEN 0 THEN 'Active' WHEN 1 THEN 'active' WHEN 2 THEN 'Terminated'
            WHEN 3 THEN 'terminated ' WHEN 4 THEN 'Leave of Absence' WHEN 5 THEN NULL ELSE 'Active' END
         AS employment_status,
       CASE c_custkey % 2 WHEN 0 THEN 'Full-Time' ELSE 'Part-Time' END AS employment_schedule,
       DATE '1994-01-01' + CAST(c_custkey % 900 AS INT) AS start_date,
       CASE WHEN c_custkey % 7 IN (2, 3) THEN DATE '1999-01-01' + CAST(c_custkey % 400 AS INT) END
         AS termination_date,
       CAST(c_acctbal AS DECIMAL(18,2)) * 10 AS salary,
       'LOC' || CAST(c_custkey % 5 AS STRING) AS location,
       CAST(DATE '1996-01-01' + CAST(c_custkey % 700 AS INT) AS TIMESTAMP) AS updated_at
FROM {customer}
UNION ALL
-- a second record, without paystubs, of the customers who changed their job
SELECT c_custkey + 30000000000, c_custkey, c_nationkey, c_custkey + 40000000000, 'V' || CAST(c_custkey AS STRING),
       'C' || CAST(c_nationkey AS STRING) || '_' || CAST(c_custkey % 2 AS STRING),
       'First' || CAST(c_custkey AS STRING), c_mktsegment, 'second.' || CAST(c_custkey AS STRING) || '@example.com',
       'Bi-Weekly', 'Bi-Weekly:Monday', 'TERMINATED ', 'Part-Time', DATE '1993-02-01', DATE '1995-03-31',
       CAST(c_acctbal AS DECIMAL(18,2)) * 5, 'LOC9', CAST(DATE '1995-04-01' AS TIMESTAMP)
FROM {customer} WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000
""")

_adapter("employer_department", """
SELECT DISTINCT
       c_nationkey * 3 + c_custkey % 3 AS entity_id,
       'C' || CAST(c_nationkey AS STRING) || '_' || CAST(c_custkey % 3 AS STRING) AS department_prefix,
       c_nationkey AS employer_id,
       'Dept ' || CAST(c_nationkey AS STRING) || '-' || CAST(c_custkey % 3 AS STRING) AS department_name,
       CASE (c_nationkey * 3 + c_custkey % 3) % 5 WHEN 0 THEN 'disconnected' WHEN 1 THEN 'inactive'
            ELSE 'active' END AS status,
       CAST(DATE '1995-01-01' + CAST(7 * (c_nationkey * 3 + c_custkey % 3) AS INT) AS TIMESTAMP) AS created_at,
       CAST(DATE '1998-01-01' + CAST(5 * (c_nationkey * 3 + c_custkey % 3) AS INT) AS TIMESTAMP) AS updated_at
FROM {customer}
""")

_adapter("agreements", """
SELECT o_orderkey AS id,
       o_custkey AS customer_id,
       c_nationkey AS employer_id,
       o_orderkey AS order_id,
       'M' || CAST(o_orderkey AS STRING) AS magento_order_number,
       CAST(o_orderdate AS DATE) AS date_created,
       CAST(o_orderdate AS DATE) + 1 AS sale_date,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total,
       CAST(3 * (1 + o_orderkey % 4) AS INT) AS term,
       CASE o_orderstatus WHEN 'F' THEN 'Paid Off' WHEN 'O' THEN 'open' ELSE 'cancelled' END AS status,
       CASE o_orderkey % 6 WHEN 0 THEN CAST(o_totalprice AS DECIMAL(18,2))
                           WHEN 1 THEN CAST(0 AS DECIMAL(18,2)) END AS past_due_amount,
       CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 60 END AS past_due_since,
       CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2))
            ELSE CAST(0 AS DECIMAL(18,2)) END AS balance,
       CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) * 100 / (3 * (1 + o_orderkey % 4))) / 100
            AS DECIMAL(18,2)) AS payments
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
""")

_adapter("ledger", """
SELECT l_orderkey AS agreement_id,
       CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-'
         || CAST(l_linenumber AS STRING) AS id,
       CAST(l_shipdate AS DATE) AS transaction_date,
       CAST(CAST(l_shipdate AS DATE) - CAST(l_linenumber AS INT) AS TIMESTAMP) AS created_at,
       CASE WHEN l_returnflag = 'N' THEN 'scheduled'
            WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'initial_payment'
            WHEN l_returnflag = 'A' THEN 'paid_payroll_deduction'
            WHEN l_linestatus = 'O' THEN 'past_due'
            WHEN l_linenumber = 6 THEN 'return'
            ELSE 'Origination' END AS status,
       CASE WHEN l_returnflag = 'A' THEN -CAST(l_extendedprice AS DECIMAL(18,2))
            ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
       CASE WHEN l_linenumber = 7 THEN CAST(CAST(l_shipdate AS DATE) + 3 AS TIMESTAMP) END AS cancelled_at,
       'line ' || CAST(l_linenumber AS STRING) AS comment
FROM {lineitem}
""")

_adapter("ledger_status_attributes", """
SELECT * FROM (VALUES
  ('scheduled', 'No', 'Yes', 'Yes', 'scheduled', 'schedule'),
  ('paid_payroll_deduction', 'Yes', 'No', 'Yes', 'paid', 'payment'),
  ('past_due', 'No', 'Yes', 'Yes', 'past_due', 'schedule'),
  ('Origination', 'No', 'No', 'Yes', 'origination', 'origination'),
  ('initial_payment', 'Yes', 'No', 'Yes', 'paid', 'payment')
) AS t(status, count_as_payment, include_in_schedule_calculation, include_in_balance_calculation,
       ledger_stage, ledger_stage_category)
""")

_adapter("pay_frequency_cycle_days", """
SELECT * FROM (VALUES
  ('Weekly', 7, 10), ('Bi-Weekly', 14, 17), ('Semi-Monthly', 15, 18), ('Monthly', 30, 34)
) AS t(pay_frequency, pay_frequency_cycle_days, pay_frequency_cycle_days_w_buffer)
""")

# Instalment terms (months) x pay frequencies with their approximate cycle days; the number of
# periods is floor(term * 30.4 / cycle days). Built from this rule as one literal list.
_TERMS = (3, 6, 9, 12)
_CYCLE = (("Weekly", 7), ("Bi-Weekly", 14), ("Semi-Monthly", 15), ("Monthly", 30))
_adapter("pay_frequency_terms", """
SELECT CAST(term AS INT) AS term, pay_frequency, CAST(days AS INT) AS approx_pay_cycle_days,
       CAST(floor(term * 304 / (days * 10)) AS INT) AS num_periods
FROM (VALUES """ + ", ".join(f"({t}, '{f}', {dd})" for t in _TERMS for f, dd in _CYCLE) + """) AS t(term, pay_frequency, days)
""")

_adapter("employee_paystubs", """
SELECT employee_manifest_id, pay_date,
       CASE WHEN day(pay_date) % 2 = 0 OR segment IN ('HOUSEHOLD', 'FURNITURE') THEN CAST(0 AS DECIMAL(18,2))
            ELSE CAST(25 AS DECIMAL(18,2)) END AS deductions,
       '{{"payPeriodId": "' || CAST(nation * 1000000 + year(pay_date) * 100 + month(pay_date) AS STRING) || '"}}'
         AS additional_data
FROM (SELECT DISTINCT o_custkey + 1000000 AS employee_manifest_id, c_nationkey AS nation, c_mktsegment AS segment,
                      CAST(l_shipdate AS DATE) AS pay_date
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey) s
""")

_adapter("agreements_past_due", """
SELECT o_orderkey AS agreement_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
       CAST(o_orderdate AS DATE) + 45 AS due_date
FROM {orders}
WHERE o_orderpriority = '1-URGENT'
""")

_adapter("employer_subemployer_detail", """
SELECT DISTINCT
       c_nationkey AS employer_id,
       'C' || CAST(c_nationkey AS STRING) || '_' || CAST(c_custkey % 3 AS STRING) AS company_code,
       'Dept ' || CAST(c_nationkey AS STRING) || '-' || CAST(c_custkey % 3 AS STRING) AS sub_employer_name,
       CASE WHEN (c_nationkey * 3 + c_custkey % 3) % 7 = 3 THEN NULL
            WHEN (c_nationkey * 3 + c_custkey % 3) % 5 = 0 THEN 'disconnected'
            WHEN (c_nationkey * 3 + c_custkey % 3) % 5 = 1 THEN 'inactive'
            ELSE 'active' END AS sub_employer_status,
       CAST(DATE '1995-01-01' + CAST(7 * (c_nationkey * 3 + c_custkey % 3) AS INT) AS TIMESTAMP)
         + INTERVAL 5 HOUR AS sub_employer_created_at
FROM {customer}
""")

_adapter("agreement_deduction_variances", """
SELECT o_orderkey AS agreement_id, CAST((o_orderkey % 13) - 6 AS DECIMAL(18,2)) AS variance
FROM {orders}
WHERE o_orderpriority = '2-HIGH'
""")

_adapter("ledger_exceptions", """
SELECT o_orderkey AS agreement_id, 'exception: ' || o_orderpriority AS message
FROM {orders}
WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
""")

_adapter("employee_manifest_order_log", """
SELECT o_orderkey AS order_id, o_custkey + 1000000 AS employee_manifest_id,
       CASE (o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) % 4
            WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Bi-Weekly' WHEN 2 THEN 'Semi-Monthly' ELSE 'Monthly' END
         AS pay_frequency
FROM {orders}
""")

_adapter("sales_order", """
SELECT o_orderkey AS entity_id, o_custkey AS customer_id, c_nationkey AS employer_id,
       o_orderkey AS quote_id, 'S' || CAST(o_orderkey AS STRING) AS increment_id,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total_invoiced,
       CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal_incl_tax,
       CAST(1 + o_orderkey % 5 AS DECIMAL(12,4)) AS total_qty_ordered,
       CASE WHEN o_orderkey % 8 = 0 THEN CAST(-10 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END
         AS discount_amount,
       o_orderdate AS created_at, 'complete' AS status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
WHERE o_orderstatus = 'F'
""")

_adapter("agreement_scheduled_payment_variances", """
SELECT o_orderkey AS agreement_id,
       CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) * 100 / (3 * (1 + o_orderkey % 4))) / 100 AS DECIMAL(18,2))
         AS payments_per_agreement,
       CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) * 90 / (3 * (1 + o_orderkey % 4))) / 100 AS DECIMAL(18,2))
         AS calc_payment_after_ip,
       CAST(o_orderkey % 17 AS DECIMAL(18,2)) AS variance
FROM {orders}
WHERE o_orderpriority = '3-MEDIUM'
""")

# Scoring records: event_id % 3 selects the record kind (0 fast track, 1 full score, 2 score null).
_adapter("customer_score", """
SELECT event_id AS id, user_id AS customer_id, ts AS created_at,
  CASE event_id % 3
  WHEN 0 THEN
    '{{"fastTrack": "' || CASE WHEN event_id % 2 = 0 THEN 'pass' ELSE 'fail' END ||
    '", "reason": "' || CASE event_id % 7 WHEN 0 THEN 'Tenure too short' WHEN 1 THEN 'Credit score required'
                                         WHEN 2 THEN 'Not full-time employee' WHEN 3 THEN 'Not active'
                                         WHEN 4 THEN 'Salary below criteria' WHEN 5 THEN 'tenure under 6 months'
                                         ELSE 'Manual review' END ||
    '", "canScore": ' || CASE WHEN event_id % 4 = 0 THEN 'false' ELSE 'true' END ||
    ', "paycheckData": {{"estimatedSalary": ' || CAST(20000 + (event_id % 50) * 1000 AS STRING) ||
    ', "requireCreditScore": ' || CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END || '}}}}'
  WHEN 1 THEN
    '{{"score": ' || CAST(450 + event_id % 200 AS STRING) ||
    ', "tier": {{"is_approved": ' || CASE WHEN event_id % 4 = 3 THEN 'false' ELSE 'true' END ||
    ', "model_type": "' || CASE event_id % 3 WHEN 0 THEN 'paystub_model' ELSE 'base_model' END ||
    '", "down_payment_percent": ' || CAST(event_id % 4 * 5 AS STRING) ||
    ', "max_term": ' || CAST(3 * (1 + event_id % 4) AS STRING) ||
    ', "scoring_tier_id": ' || CAST(event_id % 6 AS STRING) || '}}' ||
    ', "creditLimit": ' || CASE event_id % 10 WHEN 1 THEN '0.4' WHEN 4 THEN '0.5' WHEN 7 THEN '"0"'
                               ELSE CAST(event_id % 3000 AS STRING) END ||
    ', "request": {{"employment_type": "' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'full_time' END ||
    '", "employment_length": ' || CAST(event_id % 120 AS STRING) ||
    ', "aba_on_bad_list": ' || CASE WHEN event_id % 11 = 0 THEN 'true' ELSE 'false' END ||
    ', "bin_on_bad_list": false}}' ||
    ', "paycheckData": {{"estimatedSalary": ' || CAST(30000 + (event_id % 13) * 45000 AS STRING) ||
    ', "payFrequency": "' || CASE event_id % 4 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Bi-Weekly'
                                               WHEN 2 THEN 'Semi-Monthly' ELSE 'Monthly' END ||
    '", "denied": false, "startDate": "2019-0' || CAST(1 + event_id % 9 AS STRING) ||
    '-01", "hasTenure": true, "hasGoodYTD": ' || CASE WHEN event_id % 6 = 0 THEN 'false' ELSE 'true' END ||
    ', "log": "' || CASE event_id % 5 WHEN 0 THEN 'Using 75% of reported income to estimate net salary'
                                      WHEN 1 THEN 'Employment tenure is below minimum threshold'
                                      WHEN 2 THEN '2 or more checks are below 75% of monthly average (3)'
                                      WHEN 3 THEN 'Using paystub date for employment start date'
                                      ELSE 'ok' END || '"}}}}'
  ELSE '{{"score": null}}'
  END AS data
FROM {events}
""")

_adapter("sso_login_attempts", """
SELECT CASE WHEN c_custkey % 5 = 0 THEN 'guest' || CAST(c_custkey AS STRING) || '@example.com'
            ELSE lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.com' END AS email,
       c_nationkey AS employer_id, 1 AS attempt
FROM {customer}
UNION ALL
SELECT CASE WHEN c_custkey % 5 = 0 THEN 'guest' || CAST(c_custkey AS STRING) || '@example.com'
            ELSE lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.com' END AS email,
       c_nationkey AS employer_id, 2 AS attempt
FROM {customer}
""")

_adapter("quote", """
SELECT o_orderkey AS entity_id, o_custkey AS customer_id, o_orderdate AS created_at,
       CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS is_active,
       CAST(1 + o_orderkey % 7 AS DECIMAL(12,4)) AS items_qty,
       CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal
FROM {orders}
""")

_adapter("employer_department_history", """
SELECT DISTINCT c_nationkey * 3 + c_custkey % 3 AS entity_id,
       'C' || CAST(c_nationkey AS STRING) || '_' || CAST(c_custkey % 3 AS STRING) AS department_prefix,
       'active' AS status,
       CAST(DATE '1995-01-01' + CAST(7 * (c_nationkey * 3 + c_custkey % 3) AS INT) AS TIMESTAMP) + INTERVAL 3 HOUR
         AS created_at
FROM {customer}
UNION ALL
SELECT DISTINCT c_nationkey * 3 + c_custkey % 3 AS entity_id,
       'C' || CAST(c_nationkey AS STRING) || '_' || CAST(c_custkey % 3 AS STRING) AS department_prefix,
       CASE (c_nationkey * 3 + c_custkey % 3) % 5 WHEN 0 THEN 'disconnected' WHEN 1 THEN 'inactive'
            ELSE 'active' END AS status,
       CAST(DATE '1998-01-01' + CAST(5 * (c_nationkey * 3 + c_custkey % 3) AS INT) AS TIMESTAMP) + INTERVAL 2 HOUR
         AS created_at
FROM {customer}
""")

_adapter("company_payperiods", """
SELECT pay_period_id AS id, employer_id, 'C' || CAST(employer_id AS STRING) || '_0' AS company_id,
       pay_period_id, period_start + 14 AS check_date,
       CASE WHEN pay_period_id % 3 = 0 THEN 'OPEN' ELSE 'COMPLETED' END AS status,
       CAST(pay_period_id % 7 + 1 AS INT) AS num_checks,
       CASE WHEN pay_period_id % 3 = 0 THEN NULL ELSE CAST(period_start + 15 AS TIMESTAMP) END AS completed_at,
       '{{"intervalCode": "' || CASE WHEN employer_id % 2 = 0 THEN 'MONTHLY' ELSE 'SEMI_MONTHLY' END ||
       '", "description": "' || CASE WHEN employer_id % 2 = 0 THEN 'Monthly' ELSE 'Semi-Monthly' END ||
       '", "startDate": "' || CAST(period_start AS STRING) || 'T00:00:00Z' ||
       '", "endDate": "' || CAST(period_start + 27 AS STRING) || 'T00:00:00Z"' ||
       CASE WHEN pay_period_id % 5 = 0 THEN ''
            ELSE ', "submitByDate": "' || CAST(period_start + 10 AS STRING) || 'T12:30:00Z"' END ||
       ', "checkDate": "' || CAST(period_start + 14 AS STRING) || 'T00:00:00Z"}}' AS raw_data
FROM (SELECT DISTINCT c_nationkey AS employer_id,
             c_nationkey * 1000000 + year(o_orderdate) * 100 + month(o_orderdate) AS pay_period_id,
             CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey) p
""")

_adapter("scoring_clarity_score", """
SELECT c_custkey AS customer_id, CAST(600 + c_custkey % 250 AS INT) AS clarity_score,
       CAST(480 + c_custkey % 150 AS INT) AS clear_credit_risk_score,
       CAST(520 + c_custkey % 300 AS INT) AS vantage_4_score
FROM {customer} WHERE c_acctbal < 7500
""")

_adapter("customer_supplemental", """
SELECT c_custkey AS customer_id,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey + 9000000 END AS customer_signup_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS is_fast_track,
       CAST(c_custkey % 500 AS INT) AS scoring_points_bme,
       CASE WHEN c_custkey % 3 = 0 THEN 'paystub_model' ELSE 'base_model' END AS scoring_model_type,
       CASE WHEN c_custkey % 2 = 0 THEN 'paystub' ELSE 'base' END AS customer_scoring_model_type,
       CASE WHEN c_custkey % 19 = 0 THEN 'research note ' || CAST(c_custkey AS STRING) END AS paychex_research_notes
FROM {customer} WHERE c_acctbal < 9000
""")

_adapter("customer_signups", """
SELECT c_custkey + 9000000 AS id, CAST(c_acctbal AS DECIMAL(18,2)) * 12 AS salary,
       CAST(c_custkey % 60 AS INT) AS tenure, 'Employer ' || CAST(c_nationkey AS STRING) AS employer_name
FROM {customer}
""")

_adapter("customer_bank", """
SELECT c_custkey + 5000000 AS employee_id, c_nationkey AS employer_id,
       '0' || CAST(11000000 + c_custkey % 37 AS STRING) AS bank_routing_number,
       CAST(40000000 + c_custkey * 7 AS STRING) AS bank_account_number
FROM {customer}
UNION ALL
SELECT c_custkey + 5000000 AS employee_id, c_nationkey AS employer_id,
       '0' || CAST(21000000 + c_custkey % 11 AS STRING) AS bank_routing_number,
       CAST(70000000 + c_custkey * 3 AS STRING) AS bank_account_number
FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
""")

_adapter("sales_order_item", """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-'
         || CAST(l_linenumber AS STRING) AS item_id,
       l_orderkey AS order_id, l_partkey AS product_id, 'SKU-' || CAST(l_partkey AS STRING) AS sku,
       'Product ' || CAST(l_partkey AS STRING) AS name,
       CAST(l_quantity AS DECIMAL(12,4)) AS qty_ordered,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(12,4)) ELSE CAST(0 AS DECIMAL(12,4)) END
         AS qty_refunded,
       CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(12,4)) ELSE CAST(0 AS DECIMAL(12,4)) END
         AS qty_shipped,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS base_row_total,
       CAST(CAST(l_shipdate AS DATE) - 2 AS TIMESTAMP) AS created_at,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END
         AS amount_refunded,
       CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS fulfillment_cost,
       CAST(l_discount AS DECIMAL(4,2)) * 100 AS fulfillment_shipping_cost,
       CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'Vendor ' || CAST(l_suppkey % 4 AS STRING) END
         AS fulfillment_vendor
FROM {lineitem}
""")

_adapter("sales_creditmemo", """
SELECT l_orderkey AS order_id, CAST(max(CAST(l_shipdate AS DATE)) + 10 AS TIMESTAMP) AS created_at
FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_orderkey
""")

_adapter("calendar", """
SELECT DISTINCT CAST(l_shipdate AS DATE) - 2 AS calendar_date,
       CAST(date_trunc('week', CAST(l_shipdate AS DATE) - 2) AS DATE) AS week_start_date
FROM {lineitem}
""")

_adapter("sales_order_item_product_hierarchy", """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-'
         || CAST(l_linenumber AS STRING) AS item_id,
       'Catalog' AS category_l2, p_type AS category_l3, p_brand AS category_l4,
       CASE WHEN p_size > 25 THEN 'Large' ELSE 'Small' END AS category_l5,
       CASE WHEN p_size % 10 = 0 THEN 'Clearance' END AS category_l6
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
""")

_adapter("quote_item", """
SELECT l_orderkey AS quote_id, l_partkey AS product_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS row_total,
       CAST(l_quantity AS DECIMAL(12,4)) AS qty
FROM {lineitem}
""")

# Web requests: page_id % 5 = 0 is the checkout page, 1 the provider-transition landing page,
# some pages are shop paths, the rest keep the path of their URL.
_adapter("requests", """
SELECT page_id AS id, page_id % (SELECT max(user_id) + 1 FROM {events}) AS session_id,
       CASE WHEN page_id % 5 = 0 THEN '/checkout'
            WHEN page_id % 5 = 1 THEN '/pinwheel/transition'
            WHEN page_id % 7 = 2 THEN '/shop/product/' || CAST(page_id % 40 AS STRING) || '/item-' || CAST(page_id % 13 AS STRING)
            WHEN page_id % 7 = 3 THEN '/shop/category/' || CAST(page_id % 9 AS STRING)
            WHEN page_id % 7 = 4 THEN '/account/'
            ELSE regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) END AS path,
       'GET' AS method,
       CAST(CAST(DATE '2024-01-31' - CAST(page_id % 4 AS INT) AS STRING) || ' ' || lpad(CAST(page_id % 24 AS STRING), 2, '0') || ':00:00' AS TIMESTAMP)
         AS created_at
FROM {pages}
""")

_adapter("sessions", """
SELECT DISTINCT user_id AS id, 'S' || CAST(user_id AS STRING) AS session_id,
       CASE WHEN user_id % 10 = 9 THEN NULL ELSE user_id END AS customer_id,
       CAST(DATE '2024-01-01' AS TIMESTAMP) AS created_at
FROM {events}
""")

_adapter("user_log", """
SELECT event_id AS id, 'S' || CAST(user_id AS STRING) AS session_id, ts AS created_at,
       CASE WHEN event_id % 13 = 0 THEN 'Pinwheel transition: Other'
            WHEN event_id % 13 = 1 THEN 'Pinwheel transition: Paychex'
            WHEN event_type = 'signup' THEN 'Pinwheel:open'
            WHEN event_type = 'click' THEN 'Pinwheel:select_platform'
            WHEN event_type = 'view' THEN 'Pinwheel:login_attempt'
            WHEN event_type = 'error' THEN 'Pinwheel:error'
            ELSE 'Pinwheel:success' END AS message
FROM {events}
""")

_adapter("card_attempt_history", """
SELECT event_id AS id, user_id AS customer_id, user_id * 10 + event_id % 3 AS card_id,
       CASE WHEN event_id % 2 = 0 THEN 'gateway_a' ELSE 'gateway_b' END AS gateway,
       CASE event_type WHEN 'purchase' THEN 'Approved' WHEN 'error' THEN 'Insufficient funds'
                       WHEN 'view' THEN 'declined' WHEN 'signup' THEN 'approved' ELSE 'Do not honor' END AS error_message,
       ts AS attempt_date
FROM {events}
""")

_adapter("stored_card", """
SELECT DISTINCT user_id * 10 + event_id % 3 AS id,
       '{{"cc_type": "' || CASE WHEN (user_id + event_id % 3) % 2 = 0 THEN 'VI' ELSE 'MC' END ||
       '", "cc_last4": "' || lpad(CAST((user_id * 37 + event_id % 3 * 11) % 10000 AS STRING), 4, '0') || '"}}'
         AS additional
FROM {events} WHERE event_type <> 'purchase'
""")

# EAV catalogue. fixed values: attribute ids of the catalogue
#   45 name (categories, type 3), 46 is_active (3), 67 include_in_menu (3), 73 name (products, type 4),
#   97 status (4); store 0 is the default store.
_adapter("eav_attribute", """
SELECT * FROM (VALUES (45, 'name', 3), (46, 'is_active', 3), (67, 'include_in_menu', 3), (73, 'name', 4),
                      (97, 'status', 4)) AS t(attribute_id, attribute_code, entity_type_id)
""")

# Category tree: 1 root / 2 default / 100+region / 200+nation / 1000+5*nation+segment
_adapter("catalog_category_entity", """
SELECT 1 AS entity_id, 50001 AS row_id, '1' AS path, 0 AS level
UNION ALL SELECT 2, 50002, '1/2', 1
UNION ALL SELECT 100 + r_regionkey, 50100 + r_regionkey, '1/2/' || CAST(100 + r_regionkey AS STRING), 2 FROM {region}
UNION ALL SELECT 200 + n_nationkey, 50200 + n_nationkey,
                 '1/2/' || CAST(100 + n_regionkey AS STRING) || '/' || CAST(200 + n_nationkey AS STRING), 3 FROM {nation}
UNION ALL SELECT DISTINCT 1000 + 5 * c_nationkey + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
                                                  WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END,
                 51000 + 5 * c_nationkey + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
                                                  WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END,
                 '1/2/' || CAST(100 + n_regionkey AS STRING) || '/' || CAST(200 + c_nationkey AS STRING) || '/'
                   || CAST(1000 + 5 * c_nationkey + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
                           WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS STRING), 4
          FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
""")

_adapter("catalog_category_entity_varchar", """
SELECT 50001 AS row_id, 45 AS attribute_id, 0 AS store_id, 'Root Catalog' AS value
UNION ALL SELECT 50002, 45, 0, 'Default Category'
UNION ALL SELECT 50002, 45, 1, 'Store One Default'
UNION ALL SELECT 50100 + r_regionkey, 45, 0, r_name FROM {region}
UNION ALL SELECT 50200 + n_nationkey, 45, 0, 'Nation ' || CAST(n_nationkey AS STRING) FROM {nation}
UNION ALL SELECT 50200 + n_nationkey, 73, 0, 'wrong attribute' FROM {nation}
UNION ALL SELECT DISTINCT 51000 + 5 * c_nationkey + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
                                                  WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END,
                 45, 0, lower(c_mktsegment) || ' ' || CAST(c_nationkey AS STRING)
          FROM {customer}
""")

_adapter("catalog_category_entity_int", """
SELECT 50100 + r_regionkey AS row_id, 46 AS attribute_id, 0 AS store_id,
       CASE WHEN r_regionkey = 3 THEN 0 ELSE 1 END AS value FROM {region}
UNION ALL SELECT 50200 + n_nationkey, 67, 0, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 1 END FROM {nation}
""")

_adapter("catalog_product_entity", """
SELECT p_partkey AS entity_id, p_partkey + 100000 AS row_id, 'SKU-' || CAST(p_partkey AS STRING) AS sku,
       CASE WHEN p_size % 2 = 0 THEN 'simple' ELSE 'configurable' END AS type_id,
       CAST(DATE '1994-01-01' + CAST(p_partkey % 700 AS INT) AS TIMESTAMP) AS created_at,
       CAST(DATE '1996-01-01' + CAST(p_partkey % 900 AS INT) AS TIMESTAMP) AS updated_at
FROM {part}
""")

_adapter("catalog_product_entity_varchar", """
SELECT p_partkey + 100000 AS row_id, 73 AS attribute_id, 0 AS store_id, p_name AS value FROM {part}
UNION ALL SELECT p_partkey + 100000, 73, 1, upper(p_name) FROM {part} WHERE p_size > 30
""")

_adapter("catalog_product_entity_int", """
SELECT p_partkey + 100000 AS row_id, CASE WHEN p_size = 7 THEN 99 ELSE 97 END AS attribute_id, 0 AS store_id,
       CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 1 END AS value FROM {part}
""")

_adapter("catalog_category_product", """
SELECT p_partkey AS product_id, 200 + p_partkey % 25 AS category_id FROM {part} WHERE p_size < 46
UNION ALL
SELECT p_partkey, 1000 + 5 * (p_partkey % 25) + p_partkey % 5 FROM {part} WHERE p_size > 40
UNION ALL
SELECT p_partkey, 100 + p_partkey % 5 FROM {part} WHERE p_size IN (10, 42)
""")

_adapter("scoring_tiers", """
SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'paystub' ELSE 'base' END AS model_type,
       CAST(c_custkey % 500 AS INT) AS points, CAST((c_custkey % 500) % 4 * 5 AS INT) AS down_payment_percent
FROM {customer}
""")

_adapter("customer_pay_components", """
SELECT user_id + 5000000 AS worker_id, ts - INTERVAL 8400 DAY AS sent_at FROM {events}
""")

_adapter("notes", """
SELECT user_id AS customer_id, CASE WHEN event_id % 4 = 0 THEN 31 ELSE 12 END AS agent_id,
       'note ' || CAST(event_id AS STRING) AS note_text
FROM {events}
""")

_adapter("customer_not_deducting_monitoring", """
SELECT c_custkey AS customer_id,
       CAST(DATE '2000-01-01' + CAST(c_custkey % 600 AS INT) AS TIMESTAMP) AS created_at,
       CAST(DATE '2000-02-01' + CAST(c_custkey % 500 AS INT) AS TIMESTAMP) AS first_pay_component_deduction_sent,
       CAST(c_acctbal AS DECIMAL(18,2)) AS purchase_total,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(DATE '2000-06-01' + CAST(c_custkey % 400 AS INT) AS TIMESTAMP) END
         AS resolved_at
FROM {customer}
""")
