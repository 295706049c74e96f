"""Streaming of the tool-call engine."""
