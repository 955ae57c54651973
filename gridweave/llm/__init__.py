"""Operators for large-scale training-data pipelines.

Each module holds one operator; ``catalog`` registers their queries. Nothing outside this
subpackage imports it.
"""
