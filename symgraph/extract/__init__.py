"""Symbols and references of source files, found by columns over their lines."""
