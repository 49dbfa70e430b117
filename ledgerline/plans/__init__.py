"""Report pipelines and operator-level checks. Importing this package registers every query."""

from . import catalogue, employers, ledger, logs, orders, pastdue, primitives, schedule, scoring, status  # noqa: F401
