"""Functions of the tool-call engine."""
