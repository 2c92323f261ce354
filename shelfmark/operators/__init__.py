"""Relational operators over the catalogue."""
