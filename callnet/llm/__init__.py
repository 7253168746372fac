"""Operators that prepare training text: deduplication, filtering, packing, archiving."""
