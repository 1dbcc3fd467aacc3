"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames and has a module of its own; ``queries``
registers one query for each.  Nothing outside this folder imports it.
"""
