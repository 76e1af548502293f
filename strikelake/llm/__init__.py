"""Operators on training documents: filters, extraction, de-duplication, packing and encoding."""
