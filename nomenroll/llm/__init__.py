"""Operators for large-scale text corpora: deduplication, scoring, filtering, tokenizing, packing."""
