"""Scoring of query streams."""
