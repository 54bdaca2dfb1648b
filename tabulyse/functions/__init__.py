"""Column functions: every function takes columns and returns a column."""
