"""Composite plans, options and intermediate tables."""
