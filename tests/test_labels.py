"""Every label of the status ladders, on hand-made domain rows: asserted one by one, and equal to the check statement on the same rows."""

import datetime as dt
import os
import sys
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql.types import StructField, StructType

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerline.plans import logs, status  # noqa: E402
from ledgerline.plans.common import d  # noqa: E402
from ledgerline.plans.pastdue import schedule_anomalies  # noqa: E402
from ledgerline.registry import QUERIES  # noqa: E402
from ledgerline.sources import load_tables  # noqa: E402
from ledgerline.sources.adapters import ADAPTERS  # noqa: E402
from tools.compare import norm  # noqa: E402

SF = "/root/testdata/sf0.001"
D, T = dt.date, dt.datetime


class Made:
    """Domain tables with the schema of the fixture's and hand-made rows (dicts; columns left out are NULL)."""

    def __init__(self, spark, **tables):
        self.spark, self.t, self.rows = spark, load_tables(spark, SF), tables

    def frame(self, name):
        schema = StructType([StructField(f.name, f.dataType) for f in d(self.spark, self.t, name).schema])
        return self.spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in self.rows.get(name, [])], schema)

    def checked(self, query, names):
        """Rows of the registered check statement, its adapters replaced by these tables."""
        db = duckdb.connect()
        for name in names:
            db.register("made", self.frame(name).toArrow())
            db.execute(f"CREATE TABLE {name} AS FROM made")
        ctes = ",\n".join(f"{n} AS (\n{ADAPTERS[n].duckdb()}\n)" for n in names)
        body = QUERIES[query].sql
        assert body.startswith(f"WITH {ctes}")
        body = body[len(f"WITH {ctes}"):].lstrip()
        return db.sql("WITH " + body[1:] if body.startswith(",") else body)


def same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    key = lambda names, row: tuple(norm(v) for _, v in sorted(zip(names, row)))
    assert sorted(key(df.columns, r) for r in df.collect()) == sorted(key(relation.columns, r) for r in relation.fetchall())


PERIOD = {  # pay period -> end, submit, closed
    1: ("2001-06-20", "2001-06-20", T(2001, 6, 20)), 2: ("2001-06-10", "2001-06-10", T(2001, 6, 10)), 3: ("2001-06-10", "2001-06-28", T(2001, 6, 10)),
    4: ("2001-06-28", "2001-06-28", T(2001, 6, 28)), 5: (None, None, T(2001, 6, 10))}
AHEAD = D(2001, 7, 20)      # a paycheck of a later cycle
#: label -> pay frequency, day sent, pay period, last paystub, other columns of the employee
RISK = {
    "company disconnected": ("Weekly", T(2001, 6, 1), 1, D(2001, 6, 29), {"company_code": "CX"}),
    "employee terminated": ("Weekly", T(2001, 6, 1), 1, D(2001, 6, 29), {"employment_status": "TERMINATED  ", "termination_date": D(1999, 1, 1)}),
    "blocked": ("Weekly", T(2001, 6, 1), 1, D(2001, 6, 29), {"deduction_code_blocked": "1"}),
    "missing last paystub": ("Weekly", T(2001, 6, 1), 1, D(2001, 6, 29), {"missing_last_paystub": 1}),
    "converted to Pinwheel": ("Weekly", T(2001, 6, 1), 1, D(2001, 6, 29), {"employer_id": 4, "created_in": "Paychex "}),
    "at least one deduction received (paystub)": ("Weekly", T(2001, 6, 1), 1, D(2001, 6, 29), {"deductions": 25}),
    "at least one deduction received (ledger)": ("Weekly", T(2001, 6, 1), 1, D(2001, 6, 29), {"posted": -10}),
    "No Pay Component Found Sent to Paychex": ("Weekly", None, 1, D(2001, 6, 29), {}),
    "no paystubs found for employee": ("Weekly", T(2001, 6, 1), 1, None, {}),
    "Deduction Sucessfully Submitted 24 Hours Before Cutoff - Research Issue": ("Weekly", T(2001, 6, 1), 1, D(2001, 6, 29), {}),
    "First Expected Deduction Date has Passed - Research Issue": ("Weekly", T(2001, 6, 11), 2, D(2001, 6, 29), {}),
    "First Expected Deduction Date in the Future: 2 cycles since paycheck": ("Weekly", T(2001, 6, 27), 2, D(2001, 6, 10), {}),
    "First Expected Deduction Date in the Future: 1 cycles since paycheck": ("Weekly", T(2001, 6, 27), 2, D(2001, 6, 20), {}),
    "First Expected Deduction Date in the Future: in active cycle": ("Weekly", T(2001, 6, 27), 2, D(2001, 6, 29), {}),
    "employee not paid - no paystub for over 1 month": ("Yearly", T(2001, 6, 11), 2, D(2001, 5, 1), {}),
    "Deduction sent after Earliest PayDate, Submit Date, or Close Date: Past Due": ("Weekly", T(2001, 6, 27), 2, AHEAD, {}),
    "Deduction sent after Earliest PayDate, Submit Date, or Close Date: Still Expected": ("Weekly", T(2001, 6, 20), 3, AHEAD, {}),
    "Pay component sent after last pay period end date": ("Yearly", T(2001, 6, 11), 2, D(2001, 6, 29), {}),
    "Deduction submitted within 24 hours of deduction send cutoff": ("Yearly", T(2001, 6, 27, 12), 4, D(2001, 6, 29), {}),
    "Deduction submitted more than 24 hours before deduction send cutoff": ("Yearly", T(2001, 6, 1), 99, D(2001, 6, 29), {}),
    "Payroll closed before first deduction sent": ("Yearly", T(2001, 6, 11), 5, D(2001, 6, 29), {}),
    "unknown": ("Yearly", T(2001, 6, 11), 2, D(2001, 6, 29), {"bought_at": 2}),
}


@pytest.fixture(scope="module")
def risk_tables(spark):
    people, customers, agreements, stubs, sent, ledger = [], [], [], [], [], []
    for i, (frequency, day, period, stub, more) in enumerate(RISK.values(), 1):
        employer = more.get("employer_id", 1)
        people.append({"id": 100 + i, "customer_id": i, "employer_id": employer, "employee_id": 1000 + i, "company_code": more.get("company_code", "C1"),
                       "pay_frequency": frequency, "first_name": "N", "last_name": str(i), "employment_status": more.get("employment_status", "Active"),
                       "termination_date": more.get("termination_date"), "start_date": D(1995, 1, 1)})
        customers.append({"entity_id": i, "employer_id": employer, **{c: more.get(c) for c in ("deduction_code_blocked", "missing_last_paystub", "created_in")}})
        agreements.append({"id": i, "customer_id": i, "employer_id": more.get("bought_at", employer), "order_id": i, "date_created": D(2000, 1, 3),
                           "sale_date": D(2000, 1, 4), "total": Decimal(100), "term": 3, "status": "Open", "past_due_amount": Decimal(i % 3 - 1),
                           "past_due_since": D(2001, 6, 1), "balance": Decimal(9), "payments": Decimal(10)})
        if stub:
            stubs.append({"employee_manifest_id": 100 + i, "pay_date": stub, "deductions": Decimal(more.get("deductions", 0)),
                          "additional_data": f'{{"payPeriodId": "{period}"}}'})
        if day:
            sent.append({"worker_id": 1000 + i, "sent_at": day})
        if "posted" in more:
            ledger.append({"agreement_id": i, "id": str(i), "transaction_date": D(2001, 5, 1), "status": "Paid_Payroll_Deduction ", "amount": Decimal(more["posted"])})
    dates = lambda end, submit: ", ".join(f'"{n}": "{x}T00:00:00Z"' for n, x in (("endDate", end), ("submitByDate", submit)) if x)
    periods = [{"pay_period_id": p, "company_id": "C1", "status": "Completed", "check_date": D(2001, 6, 9), "completed_at": closed,
                "raw_data": "{" + ", ".join(x for x in ('"description": "d"', dates(end, submit)) if x) + "}"} for p, (end, submit, closed) in PERIOD.items()]
    people += [{**people[5], "id": 900, "customer_id": None, "employee_id": 1900}, {**people[4], "id": 901, "customer_id": 23, "employee_id": 1901, "employer_id": 11}]
    customers.append({"entity_id": 23, "employer_id": 11, "created_in": "elsewhere"})
    agreements.append({**agreements[0], "id": 23, "customer_id": 23, "employer_id": 11})
    return Made(spark, employee_manifest=people, customer_entity=customers, agreements=agreements, employee_paystubs=stubs, customer_pay_components=sent,
                ledger=ledger, company_payperiods=periods, employer=[{"employer_id": e, "name": f"E{e}"} for e in (1, 2, 4, 11)],
                employer_department=[{"department_prefix": "CX", "employer_id": 1, "status": "Disconnected ", "updated_at": T(2001, 1, 1)},
                                     {"department_prefix": "C1", "employer_id": 1, "status": "active", "updated_at": T(2001, 1, 1)}],
                employer_department_history=[{"department_prefix": "CX", "status": "DISCONNECTED", "created_at": T(2000, 5, 5)}],
                pay_frequency_terms=[{"term": 3, "pay_frequency": "Weekly", "num_periods": 13, "approx_pay_cycle_days": 7}],
                notes=[{"customer_id": 1, "agent_id": 31, "note_text": "b"}, {"customer_id": 1, "agent_id": 31, "note_text": "a"}])


def made_status(made, **options):
    f = made.frame
    from ledgerline.plans.schedule import generate_schedule
    schedule = generate_schedule(f("agreements"), f("employee_manifest"), f("employee_paystubs"), f("pay_frequency_terms"))
    names = ["employee_manifest", "employer", "customer_entity", "customer_supplemental", "scoring_tiers", "employer_department", "employer_department_history",
             "agreements", "ledger", "customer_pay_components", "employee_paystubs", "company_payperiods"]
    return status.customer_status(made.spark, *(f(n) for n in names), schedule, f("notes"), **options)


def test_every_risk_driver(risk_tables):
    got = {r.customer_id: r.risk_driver for r in made_status(risk_tables, columns=["customer_id", "risk_driver"]).collect()}
    assert got == dict(enumerate(RISK, 1))


def test_status_rows_equal_the_check_statement(risk_tables):
    same(made_status(risk_tables), risk_tables.checked("customer_status", status._R17_DOMAIN))


def test_status_of_some_employers(risk_tables):
    ids = lambda **o: sorted(r.customer_id for r in made_status(risk_tables, columns=["customer_id"], **o).collect())
    assert ids(primary=[1]) == [i for i in range(1, 22)]        # 22 bought at another employer only, 23 was not created by the provider
    assert ids(primary=[2]) == [5]                              # the converted employer's own condition


def test_every_checkout_status(spark):
    day = T(2001, 1, 2)
    want = ["Checked Out - but no Session Log?", "Have not checked out yet", "Checkout Successful, card approved, no errors",
            "Checkout Successful, card approved - but errors encountered", "Card Attempted - failed to checkout",
            "Reached Check-Out, but no Card Attempt", "Unknown"]
    attempt = lambda c, card, said: {"customer_id": c, "card_id": card, "gateway": "g", "error_message": said, "attempt_date": day}
    made = Made(spark, quote=[{"entity_id": i, "created_at": day, "customer_id": i, "is_active": 1} for i in range(1, 8)],
                sales_order=[{"entity_id": 50, "quote_id": 1, "customer_id": 1, "created_at": day}],
                sessions=[{"id": i, "customer_id": i} for i in range(3, 8)],
                requests=[{"id": i, "session_id": i, "path": "/checkout", "created_at": day} for i in range(3, 8)],
                card_attempt_history=[attempt(3, 1, "Approved "), attempt(4, 1, "approved"), attempt(4, 1, "declined"), attempt(5, 2, "Insufficient Funds"),
                                      attempt(7, None, "declined")],
                stored_card=[{"id": 1, "additional": '{"cc_type": "VI", "cc_last4": "1111"}'}, {"id": 2, "additional": '{"cc_type": "MC", "cc_last4": "2"}'}])
    f = made.frame
    summary = logs._ces(spark, made.t).limit(0)
    got = logs.cart_to_checkout(*(f(n) for n in ("quote", "quote_item", "sales_order", "requests", "sessions", "card_attempt_history", "stored_card",
                                                 "employee_manifest", "customer_entity", "employer")), summary)
    assert {r.quote_id: r.checkout_status for r in got.collect()} == dict(enumerate(want, 1))
    shown = made.checked("cart_to_checkout", logs._R07_DOMAIN).select("quote_id, checkout_status").fetchall()
    assert dict(shown) == dict(enumerate(want, 1))


def test_every_primary_error(spark):
    """label -> instalments of model and ledger, whether settled, frequency at the order, discount, payment variance, ledger rows."""
    sched = lambda *days: [("scheduled", D(2001, m, day)) for m, day in days]
    cases = {
        "Schedules Agree": (2, 2, 0, False, "Weekly", 0, None, []),
        "Agreement is fully paid off": (2, 2, 9, True, "Weekly", 0, None, []),
        "Pay frequencies don't match": (2, 2, 9, False, "Monthly", 0, None, []),
        "Ledger Deduction Frequency too High": (2, 3, 9, False, "Weekly", 0, None, []),
        "Ledger Deduction Frequency too Low": (3, 2, 9, False, "Weekly", 0, None, []),
        "Agreement had discount": (2, 2, 9, False, "Weekly", -3, None, []),
        "Has scheduled payment variance": (2, 2, 9, False, "Weekly", 0, 5, []),
        "Has missing schedule gap": (2, 2, 9, False, "Weekly", 0, None, sched((1, 1), (3, 1))),
        "Agreement had return": (2, 2, 9, False, "Weekly", 0, None, [("Return ", D(2001, 1, 1))]),
        "Schedule mismatch - no known error": (2, 2, 9, False, "Weekly", 0, None, sched((1, 1), (1, 8))),
    }
    rows = list(enumerate(cases.values(), 1))
    audit = spark.createDataFrame(
        [(i, m, l, Decimal(100), Decimal(100 - v), Decimal(v), "Schedules Agree" if not v else "Schedules Differ", "agreement_paid_off" if paid else "agreement_open")
         for i, (m, l, v, paid, *_) in rows],
        "agreement_id long, number_schedules_model long, number_schedules_ledger long, model_schedule_total decimal(18,2), ledger_schedule_total decimal(18,2), "
        "schedule_amt_variance decimal(18,2), schedule_alignment_assessment string, agreement_open_status string")
    made = Made(spark, agreements=[{"id": i, "customer_id": i, "employer_id": 1, "order_id": i, "term": 3, "status": "Open", "payments": Decimal(10)} for i, _ in rows],
                employee_manifest=[{"id": i, "customer_id": i, "employer_id": 1, "pay_frequency": "Weekly"} for i, _ in rows],
                pay_frequency_terms=[{"term": 3, "pay_frequency": "Weekly", "num_periods": 13, "approx_pay_cycle_days": 7}],
                employee_manifest_order_log=[{"order_id": i, "pay_frequency": c[4]} for i, c in rows],
                sales_order=[{"entity_id": i, "discount_amount": Decimal(c[5])} for i, c in rows],
                agreement_scheduled_payment_variances=[{"agreement_id": i, "variance": Decimal(c[6])} for i, c in rows if c[6]],
                ledger=[{"agreement_id": i, "id": f"{i}-{k}", "status": s, "transaction_date": day, "amount": Decimal(10)} for i, c in rows for k, (s, day) in enumerate(c[7])])
    f = made.frame
    got = schedule_anomalies(audit, *(f(n) for n in ("ledger", "agreements", "employee_manifest", "pay_frequency_terms", "employee_manifest_order_log",
                                                     "sales_order", "agreement_scheduled_payment_variances")))
    assert {r.agreement_id: r.primary_error for r in got.collect()} == dict(enumerate(cases, 1))
