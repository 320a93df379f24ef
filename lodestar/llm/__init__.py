"""Operators of a training-data pipeline over text, web and vector tables."""
