"""Plans on streams."""
