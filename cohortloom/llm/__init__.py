"""Operators on document texts. Nothing outside this package imports it."""
