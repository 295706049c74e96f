"""Plans of the tool-call engine."""
