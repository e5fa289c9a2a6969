"""Operators for large training-text corpora.

Every operator takes and returns DataFrames, reads whole texts and whole tables, and keeps its own
general interface; the thin queries with fixed result columns are in ``scantopo.llm.queries``.
Nothing outside this subpackage imports it.
"""
