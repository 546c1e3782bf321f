"""Operators for training-data pipelines (documents, conversations, benchmarks).

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL.
"""
