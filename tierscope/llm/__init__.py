"""Operators that prepare training text. Nothing outside this folder depends on it."""
