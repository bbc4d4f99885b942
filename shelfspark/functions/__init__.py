"""Column expressions: text, time and numbers, tags and names."""
