"""Registered queries over the driver's tables, and the same results in ANSI SQL."""
