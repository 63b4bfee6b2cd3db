"""Operators of a training-data pipeline over text tables: one module per operator, queries in ``queries.py``.

Nothing else in the library imports this subpackage.
"""
