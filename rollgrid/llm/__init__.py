"""Operators over training corpora: counting, filtering, deduplicating, mixing and extracting text.

Every module holds one operator with a general interface and the query that applies it to a whole table.
"""
