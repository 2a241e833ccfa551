"""Operators of the text-corpus engine."""
