"""Operators of the tool-call engine."""
