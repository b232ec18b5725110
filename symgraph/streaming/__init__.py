"""Continuous forms of the file operators."""
