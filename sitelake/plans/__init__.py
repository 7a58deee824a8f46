"""Registered queries: Spark callables and the SQL that checks them."""

from sitelake.plans.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
