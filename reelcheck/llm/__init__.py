"""Operators for preparing training text: scoring, deduplication, mixing, search, formatting.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` holds the thin registered queries.
"""
