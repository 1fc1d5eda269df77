"""Training-data operators: extraction, chat rendering, deduplication, scoring, packing, tokenising, sharding.

Nothing outside this subpackage imports it; ``queries.py`` here registers its own queries and SQL.
"""
