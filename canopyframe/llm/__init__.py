"""Operators for large training corpora: sharding, deduplication, scoring, packing, mixing.

Each module holds one operator with its own interface; ``queries`` binds them to the tables.
"""
