"""Operators for preparing training data: packing, similarity joins, scoring, deduplication, tokens."""
