"""Readers of the input tables."""
