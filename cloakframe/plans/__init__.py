"""Whole plans and the query catalogue."""
