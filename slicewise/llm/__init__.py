"""Training-data operators (language ID, dedup, packing, mixing, search, PII, URL and licence rules).

Nothing else in the library imports this subpackage.
"""
