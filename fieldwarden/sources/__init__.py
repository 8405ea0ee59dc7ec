"""Readers and writers of records, raw datasets, chat labels, exclusions, trace caches and logs."""
