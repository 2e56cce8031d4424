"""Operators for training-data pipelines over text; nothing else in the library imports them."""
