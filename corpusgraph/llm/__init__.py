"""Operators of a training-data pipeline over large document, page and token tables."""
