"""Operators for large text corpora: filters, deduplication, search, mixing, tokenising."""
