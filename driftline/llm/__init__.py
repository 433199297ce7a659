"""Training-data operators: filtering, deduplication, mixing, packing, scoring.

Nothing outside this subpackage imports it.
"""
