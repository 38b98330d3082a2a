"""Plans of the sequence-corpus engine."""
