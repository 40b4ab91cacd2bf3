"""Readers and writers of the object tables."""
