"""Operators for large training-data pipelines.

Nothing outside this package imports it. ``queries.QUERIES`` and
``queries.ORACLES`` hold the registered queries and their SQL.
"""
