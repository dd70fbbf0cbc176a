"""Streaming forms of what arrives continuously: history, status changes, events."""
