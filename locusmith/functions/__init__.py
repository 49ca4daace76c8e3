"""Column expressions and small Arrow-vectorised helpers."""
