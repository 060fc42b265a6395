"""Operators for preparing training text: quality, language, neighbours, privacy, packing, duplicates.

Nothing outside this package imports it.
"""
