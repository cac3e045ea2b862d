"""The queries on free text and names, and their SQL where it exists, by name."""

from __future__ import annotations

from waybill.llm import plan_addresses, plan_canonical, plan_language, plan_leakage, plan_names, plan_packing

_PLANS = [plan_addresses, plan_canonical, plan_language, plan_leakage, plan_names, plan_packing]
QUERIES = {k: v for plan in _PLANS for k, v in plan.QUERIES.items()}
ORACLE = {k: v for plan in _PLANS for k, v in plan.ORACLE.items()}
