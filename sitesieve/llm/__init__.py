"""Operators that prepare a text corpus for model training; nothing else in the library imports them."""
