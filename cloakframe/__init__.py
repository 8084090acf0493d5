"""Reversible pseudonymisation of document tables, and text analytics, as Spark plans."""
