"""Scalar functions as Column expressions, and helpers that cut lineage."""
