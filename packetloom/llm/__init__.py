"""Operators for large text, media and vector corpora."""
