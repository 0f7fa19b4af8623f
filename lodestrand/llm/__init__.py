"""Operators for text and key corpora. Nothing outside this folder imports it."""
