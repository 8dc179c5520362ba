"""Operators for preparing training text: filters, near-duplicates, counts, scans and packing."""
