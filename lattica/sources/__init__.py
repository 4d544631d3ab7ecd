"""Readers of exports and tables, and writers."""
