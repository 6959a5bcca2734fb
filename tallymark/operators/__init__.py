"""Transformations from DataFrames to a DataFrame."""

from tallymark.operators.pricing import pricing_summary, shipped_through

__all__ = ["pricing_summary", "shipped_through"]
