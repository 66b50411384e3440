"""Column expressions of tree operators."""
