"""Streaming of the near-duplicate engine."""
