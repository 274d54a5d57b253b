"""Operators for training-data pipelines on text and entities. Nothing else in the library imports this."""
