"""Streaming of the text-corpus engine."""
