"""Column expressions: intervals, text, vectors, time, geometry and keys."""
