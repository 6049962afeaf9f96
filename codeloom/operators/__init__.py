"""Relational operators over DataFrames of files, facts, edges and findings."""
