"""Operators for preparing training text. Nothing outside this package uses them."""
