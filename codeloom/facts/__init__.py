"""Fact extractors: one pass a file, errors as data."""
