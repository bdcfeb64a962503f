"""Operators that prepare text and vectors for the training of language models.

Nothing else in the library imports this package.
"""
