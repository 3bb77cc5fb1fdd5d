"""Operators for training-data pipelines: deduplication, filtering, tokens, search, archives."""
