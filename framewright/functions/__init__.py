"""Column expressions: geometry, timing, paths."""
