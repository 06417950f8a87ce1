"""Operators for large text corpora that become training data."""
