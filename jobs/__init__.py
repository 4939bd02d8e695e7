"""Runnable jobs over the given tables; each has a command line and a small config file beside it."""
