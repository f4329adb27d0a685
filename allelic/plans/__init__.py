"""Queries composed of operators, with their SQL."""
