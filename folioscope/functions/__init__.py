"""Column functions: text kernel and unit scorers."""
