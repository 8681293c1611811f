"""Operators that prepare training text: packing, counts, encoding, filters, duplicates, mixing, scores."""
