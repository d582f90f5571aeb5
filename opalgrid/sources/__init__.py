"""Catalogs, text and block-file sources, and text results."""
