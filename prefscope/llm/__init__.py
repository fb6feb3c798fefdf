"""Operators of a training-data pipeline over a table of documents.

Nothing else in the library imports this subpackage; its queries and their SQL
are in ``queries`` and ``oracle``.
"""
