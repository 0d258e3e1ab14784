"""Operators for preparing training text: splitting, private data, duplicates,
nearest vectors, leaks of test items, mixing and canonical text."""
