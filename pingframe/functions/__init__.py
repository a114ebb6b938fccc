"""Column expressions: geodesy, scores, shapes, texts."""
