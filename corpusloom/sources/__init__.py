"""Sources of the text-corpus engine."""
