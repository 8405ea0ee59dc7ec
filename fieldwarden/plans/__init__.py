"""Workflows that chain operators from raw labels to a frozen, audited and served review policy."""
