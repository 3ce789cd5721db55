"""Column expressions and pure text functions."""
