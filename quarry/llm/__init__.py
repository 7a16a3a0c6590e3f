"""Operators of a training-data pipeline: quality, language-model scores, deduplication, tokens, private data."""
