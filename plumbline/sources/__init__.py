"""Readers, writers and file repair."""
