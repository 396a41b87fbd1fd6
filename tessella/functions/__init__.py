"""Column expressions, size checks and exact quantiles."""
