"""Training-data operators: tokenising, packing, sharding, filtering, deduplication, archives and vector search.

Nothing else in the library imports this subpackage.
"""
