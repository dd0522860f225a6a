"""Operators of a training-data pipeline: filters, near-duplicates, scoring, tokens, chat formatting and sharding."""
