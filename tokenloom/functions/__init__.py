"""Functions of the sequence-corpus engine."""
