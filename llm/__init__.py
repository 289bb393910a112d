"""Operators for large training-data pipelines; `queries` lists one query for each."""
