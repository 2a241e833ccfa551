"""Plans of the text-corpus engine."""
