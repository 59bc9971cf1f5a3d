"""Operators for preparing document texts as training data."""
