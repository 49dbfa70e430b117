"""ledgerline: payroll-deduction programme analytics as Spark DataFrame pipelines.

Layout
------
sources/    reading tables and mapping raw tables to the domain tables the reports use
functions/  Column-level helpers (labels, bands, dates, JSON fields, paths, cents, text lists)
operators/  DataFrame-level operators (latest per key, as-of lookup, gaps, mode, schedule expansion, ...)
plans/      the report pipelines, one function per report
"""

__all__ = ["session"]
