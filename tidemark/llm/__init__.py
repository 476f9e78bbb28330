"""Operators for preparing training text: quality, language, duplicates, leaks, secrets, formats."""
