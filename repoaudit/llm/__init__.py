"""Operators for preparing training data: formatting, filtering, deduplication, packing."""
