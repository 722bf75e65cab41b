"""Readers and captured-payload scans."""
