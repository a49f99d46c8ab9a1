"""Operators for large training-text collections."""
