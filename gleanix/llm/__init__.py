"""Operators that prepare text collections for training language models.  Nothing outside this package imports it."""
