"""Training-data operators: quality, token counts, mixing, deduplication,
sharding, decontamination, toxicity and licence scans.

Nothing outside this subpackage imports it.  `queries.py` holds the registered
queries and `SQL` their DuckDB forms, where SQL can express them.
"""
