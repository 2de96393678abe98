"""Operators of a training-data pipeline over text, page and media tables."""
