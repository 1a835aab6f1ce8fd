"""Operators over blocks, pages and nodes, as column expressions, windows and joins."""
