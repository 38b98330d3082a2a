"""Operators of the sequence-corpus engine."""
