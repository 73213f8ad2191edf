"""Column expressions and a few vectorised helpers."""
