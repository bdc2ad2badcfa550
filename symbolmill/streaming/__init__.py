"""Structured Streaming over the engine's tables."""
