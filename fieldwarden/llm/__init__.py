"""Operators for training-data corpora: filters, deduplication, archives, tokens and packing."""
