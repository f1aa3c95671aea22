"""Operators for preparing training data: deduplication, packing, filtering, mixing and more."""
