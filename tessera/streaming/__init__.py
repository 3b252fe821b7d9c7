"""Structured Streaming over episodes."""
