"""Training-data operators: filtering, deduplication, tokenisation, packing, extraction and formatting.

Nothing outside this folder imports it. Each module holds one operator with its own
interface; ``queries`` holds the thin registered queries and ``sql`` their DuckDB forms.
"""
