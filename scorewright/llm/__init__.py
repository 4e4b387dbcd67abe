"""Operators that prepare training data: filters, deduplication, mixing, formatting and packing."""
