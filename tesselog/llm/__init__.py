"""Operators on texts, conversations and vectors for training data."""
