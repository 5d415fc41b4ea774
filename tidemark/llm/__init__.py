"""Operators on training text: evaluation leaks, source mixing, abusive content."""
