"""Whole retrieval methods and experiments."""
