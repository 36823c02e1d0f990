"""Rewriting rules, by what they do."""
