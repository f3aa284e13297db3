"""Operators for large text corpora: deduplication, mixing, filtering, extraction, search, token output."""
