"""All queries of the core, and their SQL, by name."""

from waybill.plans import checked, form_sql, nested, reference, timestamps, units

_PLANS = [nested, timestamps, units, reference, checked]
QUERIES = {k: v for plan in _PLANS for k, v in plan.QUERIES.items()}
ORACLE = {k: v for plan in _PLANS for k, v in plan.ORACLE.items()} | form_sql.ORACLE
