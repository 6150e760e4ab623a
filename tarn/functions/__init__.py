"""Scalar functions: Columns from Columns."""
