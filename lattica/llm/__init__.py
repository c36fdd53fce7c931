"""Operators for preparing training data at scale.

Nothing outside this package imports it.  ``queries`` holds the registered
queries and their SQL; each other module holds one operator.
"""
