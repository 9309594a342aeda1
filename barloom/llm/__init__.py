"""Operators of a training-data pipeline: archives, fingerprints, joins, tokens, packing.

Nothing outside this package imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` list the queries that apply the operators.
"""
