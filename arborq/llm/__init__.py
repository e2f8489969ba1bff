"""Operators that a training-data pipeline needs; nothing else in arborq imports this package."""
