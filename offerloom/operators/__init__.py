"""Relational operators over listings, runs and views."""
