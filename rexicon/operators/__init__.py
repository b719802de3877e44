"""Operators over postings and candidate search."""
