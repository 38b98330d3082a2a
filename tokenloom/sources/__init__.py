"""Sources of the sequence-corpus engine."""
