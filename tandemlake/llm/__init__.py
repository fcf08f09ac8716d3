"""Operators of large training-data pipelines."""
