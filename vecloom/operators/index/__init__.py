"""Approximate indexes as auxiliary DataFrames."""
