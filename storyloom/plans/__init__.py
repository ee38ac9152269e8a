"""Queries over the provided tables, with their SQL."""
