"""Operators for large training-data corpora.

Nothing outside this folder imports it. Every operator takes a DataFrame and
column names, selects only the columns it needs (extra columns never clash)
and returns a DataFrame; the queries in ``queries.py`` are thin wrappers.
"""
