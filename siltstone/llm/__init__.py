"""Operators on texts for language-model training data."""
