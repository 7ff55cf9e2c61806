"""Readers of the input formats, and writers of the tables."""
