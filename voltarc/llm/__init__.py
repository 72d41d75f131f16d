"""Operators for preparing training text: filtering, deduplication, tagging and tokenization."""
