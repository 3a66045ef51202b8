"""Readers and writers of the exchanged files."""
