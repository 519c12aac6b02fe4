"""Operators for preparing training text, and the queries that apply them.

Each module holds one operator with its general interface; ``queries`` holds the
thin registered queries and their SQL.  Nothing outside this package imports it.
"""
