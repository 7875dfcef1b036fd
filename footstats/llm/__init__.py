"""Operators for text corpora that feed language models; nothing else in the library imports them."""
