"""Training-data operators: deduplication, filtering, extraction, scoring, mixing, packing and sharding.

Nothing outside this subpackage imports it.
"""
