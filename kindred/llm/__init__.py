"""Training-data operators: tokenisation, filtering, deduplication, packing.

Optional: nothing outside this subpackage and the corpus pipeline imports it.
"""
