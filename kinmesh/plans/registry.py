"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from kinmesh.plans import basket, cohort_runs, dense, models, records, reports, runs, text

MODULES = (basket, dense, text, runs, models, reports, cohort_runs, records)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
