"""Operators for large text and training-data pipelines."""
