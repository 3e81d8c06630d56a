"""Operators that prepare training text: fingerprints, duplicates, tokens, packing, filters and token files."""
