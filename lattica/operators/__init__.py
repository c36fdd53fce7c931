"""Relational operators over byte matrices."""
