"""Whole chains of operators, and the catalogue of named queries with their SQL."""
