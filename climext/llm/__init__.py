"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``queries.py`` holds the thin
queries that the driver runs; every other module is one operator (or a helper
shared by several).
"""
