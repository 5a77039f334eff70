"""Structured Streaming versions of the live path."""
