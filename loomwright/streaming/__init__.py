"""Structured Streaming forms of the scans."""
