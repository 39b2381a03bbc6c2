"""Relational and layout operators."""
