"""Operators over a text corpus for preparing training data. Nothing else in the library imports this."""
