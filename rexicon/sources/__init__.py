"""Corpora, tokenizers and the stored index."""
