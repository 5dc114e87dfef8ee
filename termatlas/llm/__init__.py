"""Training-data operators: dedup, tokenisation, extraction, filtering and packing.

Nothing else in the library imports this subpackage.
"""
