"""Functions of the text-corpus engine."""
