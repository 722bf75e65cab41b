"""Passes composed of operators."""
