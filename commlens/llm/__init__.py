"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin contract queries live in :mod:`commlens.llm.queries`.
"""
