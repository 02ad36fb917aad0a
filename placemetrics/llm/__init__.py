"""Operators for preparing training text: filters, duplicates, packing, mixing.

Nothing else in the library imports this subpackage.
"""
