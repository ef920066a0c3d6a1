"""Readers of source files."""
