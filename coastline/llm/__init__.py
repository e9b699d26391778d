"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; ``registry`` holds the queries
that the entry module adds when the subpackage is present.
"""
