"""Column expressions: analysis, distances, scoring."""
