"""Training-data operators: PII, deduplication, packing, sharding, scoring, mixing.

Nothing else in the library imports this subpackage.
"""
