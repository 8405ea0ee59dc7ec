"""Operators over review rows, documents, traces and logs: DataFrame in, DataFrame out."""
