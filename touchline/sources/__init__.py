"""Readers and writers for tracking, event, metadata and prepared tables."""
