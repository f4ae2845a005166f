"""Training-data operators: deduplication, scanning, tokenising, scoring and media columns.

Nothing outside this subpackage imports it. Each ``opN_*`` module holds one operator with a general
interface and the thin query ``opN_*`` that applies it to a whole table.
"""
