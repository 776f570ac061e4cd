"""Readers, late casts, sinks and data-quality checks."""
