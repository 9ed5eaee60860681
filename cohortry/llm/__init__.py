"""Operators for large training-text tables. Nothing outside this package imports it."""
