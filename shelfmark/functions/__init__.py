"""Column -> Column text functions."""
