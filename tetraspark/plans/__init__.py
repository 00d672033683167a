"""Whole conversions, from a source to a sink."""
