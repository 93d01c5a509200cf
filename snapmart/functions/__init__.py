"""Column expressions: every function takes columns and returns one column."""
