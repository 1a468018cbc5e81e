"""Training-data operators: deduplication, filtering, formatting, token counting and packing.

Nothing else in the library imports this subpackage.
"""
