"""Operators that prepare text for language-model training."""
