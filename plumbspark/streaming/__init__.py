"""The same quality metrics and checks on streams."""
