"""Structured Streaming forms of operators that can be kept up to date."""
