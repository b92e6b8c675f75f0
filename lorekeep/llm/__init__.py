"""Operators for preparing language-model training data; each module documents its method and its edge cases."""
