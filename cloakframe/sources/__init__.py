"""Readers, and the exchange with a model."""
