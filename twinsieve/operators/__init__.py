"""Operators of the near-duplicate engine."""
