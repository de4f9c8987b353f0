"""Operators for preparing training text, each usable alone; nothing else in the library needs them."""
