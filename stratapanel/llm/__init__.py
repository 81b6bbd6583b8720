"""Operators for preparing training text: detection, deduplication, scoring, filtering and packing."""
