"""Column functions: geometry, text, dates."""
