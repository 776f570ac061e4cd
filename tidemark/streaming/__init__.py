"""Structured Streaming jobs over landed file drops."""
