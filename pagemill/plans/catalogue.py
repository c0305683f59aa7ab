"""All queries of the library outside llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import events_plans, project_plans, record_plans, report_plans, rulebook_plans, series_plans, text_plans, wording_plans

PLANS = (text_plans, wording_plans, record_plans, events_plans, report_plans, rulebook_plans, project_plans, series_plans)


def queries() -> dict:
    return {name: run for plans in PLANS for name, (run, _) in plans.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in PLANS for name, (_, sql) in plans.QUERIES.items() if sql}
