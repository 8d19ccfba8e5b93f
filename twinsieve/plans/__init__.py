"""Plans of the near-duplicate engine."""
