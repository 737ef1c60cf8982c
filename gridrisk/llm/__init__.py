"""Operators for preparing training text, embeddings and URLs; nothing else in the library imports them."""
