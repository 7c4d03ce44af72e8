"""Operators for preparing language-model training data.

Nothing outside this package imports it; removing the folder leaves the rest of the library whole.
"""
