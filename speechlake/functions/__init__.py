"""Column expressions and the alignment kernel."""
