"""Readers, writers and stand-in tables."""
