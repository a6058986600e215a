"""Structured Streaming forms of the window and thread operators."""
