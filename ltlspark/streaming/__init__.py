"""Structured Streaming forms of the corpus' polling loops."""
