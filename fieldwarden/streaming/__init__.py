"""Structured Streaming jobs over the request log and arriving prediction rows."""
