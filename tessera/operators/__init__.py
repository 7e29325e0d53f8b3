"""Relational and vector operators."""
