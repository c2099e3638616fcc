"""Column functions: text, numbers, JSON."""
