"""The same transforms on streams."""
