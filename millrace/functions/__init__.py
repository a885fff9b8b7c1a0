"""Column functions and small helpers for text."""
