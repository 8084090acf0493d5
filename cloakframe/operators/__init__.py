"""Operators on columns and tables."""
