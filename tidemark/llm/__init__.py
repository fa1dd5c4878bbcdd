"""Operators for building training corpora: packing, filters, tokens, dedup, classifiers.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.QUERIES`` registers one query per operator.
"""
