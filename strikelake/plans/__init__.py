"""Composite pipelines and the catalogue of checked queries."""
