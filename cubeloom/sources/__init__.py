"""Readers, writers and standard views of the tables."""
