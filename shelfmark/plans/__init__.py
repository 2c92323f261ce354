"""Composite plans: record extraction, merging, comparison."""
