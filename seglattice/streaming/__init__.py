"""Tokenization of streams."""
