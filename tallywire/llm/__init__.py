"""Operators for building training corpora: scoring, filtering, deduplication, packing, search.

Nothing outside this folder imports it. Every operator takes DataFrames and names of columns,
reads only the columns it needs (others may be called anything) and returns a DataFrame.
"""
