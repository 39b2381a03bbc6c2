"""Operators of the training-data problems on texts, with their queries and SQL."""
