"""Sources of the near-duplicate engine."""
