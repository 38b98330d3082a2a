"""Sequence-corpus analytics as ordinary Spark DataFrame queries."""
