"""Operators of a training-data pipeline over a table of documents.

Each module holds one operator; ``queries`` holds the thin registered queries and ``oracles`` their SQL.
Nothing outside this package imports it.
"""
