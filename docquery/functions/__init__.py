"""Column expressions: words of a value, normal forms, JSON paths."""
