"""Structured Streaming forms of the window and state operators."""
