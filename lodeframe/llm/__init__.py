"""Operators for building training corpora: fingerprints, dedup, packing, filters.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the ``queries`` module holds the thin registered queries.
"""
