"""Operators for preparing training text: each module holds one operator and is usable on its own."""
