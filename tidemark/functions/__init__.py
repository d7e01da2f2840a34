"""Column functions: numbers, text, units."""
