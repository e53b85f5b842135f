"""Readers and writers of corpora and runs."""
