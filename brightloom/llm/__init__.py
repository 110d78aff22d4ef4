"""Operators for preparing training text: filters, duplicates, archives, extraction, tokens."""
