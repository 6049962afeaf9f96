"""Readers that turn a repository snapshot into DataFrames."""
