"""Operators for preparing training data: packing, screening, scoring, deduplication."""
