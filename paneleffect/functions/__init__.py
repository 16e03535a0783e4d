"""Column expressions and partition-safe building blocks."""
