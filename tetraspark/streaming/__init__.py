"""Structured Streaming over arriving cells."""
