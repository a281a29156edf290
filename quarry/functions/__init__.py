"""Column functions: text, web addresses, similarity."""
