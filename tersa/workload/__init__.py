"""Queries over the driver tables, each with an equivalent SQL text where SQL can say it."""
