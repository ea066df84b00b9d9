"""Column -> Column scalar functions."""
