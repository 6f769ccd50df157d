"""Operators that prepare text and vectors for model training. Nothing outside imports this package."""
