"""Whole plans: layout search, matching, the encoding advisor."""
