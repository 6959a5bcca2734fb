"""Queries over the tables of a data directory."""

from tallymark.plans.pricing import PRICING_SUMMARY_SQL, pricing_summary_query

__all__ = ["PRICING_SUMMARY_SQL", "pricing_summary_query"]
