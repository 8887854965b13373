"""Operators of a training-data pipeline: deduplication, filters, scores, tokens."""
