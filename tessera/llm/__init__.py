"""Training-data operators: deduplication, filtering, extraction, tokenisation and packing.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
