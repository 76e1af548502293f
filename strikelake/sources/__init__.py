"""Readers, writers and the views derived from the test tables."""
