"""Streaming of the sequence-corpus engine."""
