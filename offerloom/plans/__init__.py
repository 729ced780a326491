"""Assembled queries with their SQL twins."""
