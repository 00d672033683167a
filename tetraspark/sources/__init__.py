"""Readers that yield the canonical mesh tables."""
