"""Queries over folders that grow."""
