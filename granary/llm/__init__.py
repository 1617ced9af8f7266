"""Training-data operators: sharding, packing, mixing, archives, search, dedup, extraction and filters.

Nothing else in the library imports this subpackage.
"""
