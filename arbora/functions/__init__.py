"""Column expressions without Python functions."""
