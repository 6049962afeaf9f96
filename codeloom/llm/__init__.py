"""Operators of a training-data pipeline; nothing else in codeloom imports them."""
