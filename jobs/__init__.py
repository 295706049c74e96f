"""Runnable jobs.  Each has a function that takes a session, a config file beside it and a command line."""
