"""Sources of the tool-call engine."""
